"""Masked pseudo-likelihood of documents under a bidirectional window network.

Every word is predicted from the words on both its sides, as if it were masked. The most
frequent words of the corpus are classes of their own; any other word belongs to the class
of its last two letters and is then predicted itself. So every word gets a probability:

    P(word | window) = P(class | window) * P(word | class)      (1 for a class of one word)

P(class | window): a network in numpy, one tanh layer over an embedding for each place of
the window, its output a tree of two levels: classes by their counts, few to a branch where they
are frequent. It is trained on every word of the corpus: each task goes once through its part from a
common beginning, and what they learned is averaged; the same reading counts letters. P(word | class): how often the whole corpus, the document
itself left out, has the word among those of its class, with a letter model of the corpus's
words as a prior (Witten-Bell). These counts are a table that grows with the corpus, joined
to the words of each document.

Defined results for odd input
-----------------------------
* A null or empty text, or one without a word, has no tokens: log_likelihood 0, mean null.
* A word that the corpus lacks has the probability of its spelling.
* Null ids and repeated rows keep their own result rows; whole texts of any length are read.
* A corpus without words gives a model of spelling alone; an empty table an empty result.
* Columns other than id and text are not read, whatever their names.
"""

from __future__ import annotations

import math
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mergeloom.llm.common import Scratch
from mergeloom.llm.words import Words, find_words, hash_words, mixed, row_slices

#: ASCII characters that are no part of a word.
BETWEEN = bytes(c for c in range(128) if not chr(c).isalnum())
#: Letter codes: 0 border, 1 to 26 a to z, 27 a digit, 28 to 31 bytes above 127 by 32s; and how many bytes share a code.
CODES = 32
SHARED_BY = np.array([1] * 27 + [10] + [32] * 4)
ENDINGS = CODES * CODES
BORDER = 0
#: No exponential of a 32-bit number up to this is out of range.
LARGEST = 80
#: Words on each side.
REACH = 2
#: Hashes are looked up by so many of their first bits.
SLOT_BITS = 18
SHIFT = np.uint64(64 - SLOT_BITS)


def byte_codes() -> np.ndarray:
    codes = np.zeros(256, np.int32)
    for k in range(26):
        codes[ord("a") + k] = codes[ord("A") + k] = 1 + k
    codes[ord("0") : ord("9") + 1] = 27
    codes[128:] = 28 + np.arange(128) // 32
    return codes


class Spelling(NamedTuple):
    """Words of a batch, text by text, and the letter codes of all its bytes with two borders before and three after."""

    words: Words
    codes: np.ndarray

    @property
    def endings(self) -> np.ndarray:
        """Codes of each word's last two letters as one number."""
        last = self.words.ends + 1  # codes has two borders in front
        return self.codes[last - 1].astype(np.int32) * CODES + self.codes[last]

    def bytes_of(self, rows: np.ndarray, less: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """Places in the data of all bytes of the words `rows`, the last `less` of each left out, and how many each has."""
        sizes = self.words.ends[rows] - self.words.starts[rows] - less
        return np.repeat(self.words.starts[rows] - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum())), sizes

    def steps(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """From the last letter but two to the border in front of each word of `rows` (two letters or more): the three letters after as one number, the letter, and the word's number of steps."""
        at, sizes = self.bytes_of(rows, 1)  # of place p the letter before it, at p + 1 in codes
        own, one, two, three = (self.codes[at + k] for k in range(1, 5))
        two[one == 0] = 0
        three[two == 0] = 0
        return (one.astype(np.int32) * CODES + two) * CODES + three, own, sizes


def spelled(texts: pa.Array) -> Spelling:
    texts = pc.fill_null(texts, b"").cast(pa.binary())
    words = find_words(pc.binary_join_element_wise(texts, pa.scalar(b""), pa.scalar(b" ")), BETWEEN)  # a border between texts
    codes = words.data.tobytes().translate(byte_codes().astype(np.uint8).tobytes())
    return Spelling(words, np.frombuffer(bytes(2) + codes + bytes(3), np.uint8))


def spelling_logs(batch: Spelling, table: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Log-probability of the words `rows` given their last two letters: from there to the front, border included."""
    out = np.zeros(len(rows))
    at, sizes = batch.bytes_of(rows)
    if len(rows):
        out -= np.add.reduceat(np.log(SHARED_BY)[batch.codes[at + 2]], np.cumsum(sizes) - sizes)
    long = np.flatnonzero(sizes > 1)
    if len(long):
        context, own, sizes = batch.steps(rows[long])
        out[long] += np.add.reduceat(table.ravel()[context * CODES + own].astype(np.float64), np.cumsum(sizes) - sizes)
    return out


class Classes(NamedTuple):
    """Hashes of the words with a class of their own, in order, and their classes; then a class for each ending."""

    hashes: np.ndarray
    classes: np.ndarray

    @property
    def number(self) -> int:
        return 1 + len(self.hashes) + ENDINGS

    def of(self, hashes: np.ndarray, endings: np.ndarray) -> np.ndarray:
        out = 1 + len(self.hashes) + endings.astype(np.int64)
        if len(self.hashes):
            # by a hash's first bits the place of one of the hashes that begin so; where several do, another may be meant
            first, places = self.hashes >> SHIFT, np.zeros(1 << SLOT_BITS, np.int32)
            places[first] = np.arange(len(first))
            slots = hashes >> SHIFT
            at = places.take(slots)
            own = self.hashes.take(at) == hashes
            several = np.zeros(1 << SLOT_BITS, bool)
            several[first[1:][first[1:] == first[:-1]]] = True
            left = np.flatnonzero(several.take(slots) & ~own)
            at[left] = np.minimum(np.searchsorted(self.hashes, hashes[left]), len(self.hashes) - 1)
            own[left] = self.hashes[at[left]] == hashes[left]
            out[own] = self.classes[at[own]]
        return out


class Network(NamedTuple):
    """places: an embedding for each place of the window and class; branch and leaf say where a class stands in the tree."""

    places: np.ndarray
    bias: np.ndarray
    branch: np.ndarray
    leaf: np.ndarray
    branch_out: np.ndarray
    branch_bias: np.ndarray
    leaf_out: np.ndarray
    leaf_bias: np.ndarray


class Model(NamedTuple):
    classes: Classes
    network: Network
    letters: np.ndarray  # log-probability by the three letters after, and letter
    tokens: list[int]  # by ending: tokens of the corpus whose words have no class of their own
    types: list[int]  # and their distinct words


def windows(own: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Classes at the 2 * REACH places around each word, text by text; BORDER outside the text."""
    at = np.arange(len(own)) + np.repeat(REACH * np.arange(1, len(counts) + 1), counts)
    spaced = np.full(len(own) + REACH * (len(counts) + 1), BORDER, own.dtype)  # borders before, between and after the texts
    spaced[at] = own
    return np.stack([spaced.take(at + step) for step in (*range(-REACH, 0), *range(1, REACH + 1))])


def narrow(own: np.ndarray, number: int) -> np.ndarray:
    """Classes in two bytes if `number` of them allows it: quicker to look up, and ordered digit by digit."""
    return own.astype(np.uint16) if number <= 1 << 16 else own


def hidden(n: Network | Weights, window: np.ndarray, out: np.ndarray, room: np.ndarray) -> None:
    """What the hidden layer gives, into all columns of out but the last; room has as many rows, and a column less."""
    total = n.places[0].take(window[0], axis=0, out=room, mode="clip")  # all classes are in range; clip writes into room directly
    total += n.bias
    for k in range(1, len(window)):
        total += n.places[k].take(window[k], axis=0)
    np.tanh(total, out=out[:, :-1])


def column_sums(out: np.ndarray) -> float:
    """What an output's logit can be at most, the hidden layer being between -1 and 1."""
    return float(np.abs(out).sum(axis=0).max())


def _logs(h: np.ndarray, out: np.ndarray, wanted: np.ndarray, small: bool) -> np.ndarray:
    """Log-probability of one output for each row of h; the last row of out is its bias; small: none of its exponentials is out of range."""
    logits = h @ out
    if not small:
        logits -= logits.max(axis=1, keepdims=True)
    picked = logits.ravel().take(np.arange(0, logits.size, out.shape[1]) + wanted)
    np.exp(logits, out=logits)
    return picked - np.log(logits @ np.ones(out.shape[1], np.float32))


def class_logs(n: Network, window: np.ndarray, own: np.ndarray, step: int = 1024) -> np.ndarray:
    """Log-probability of each word's class in its window."""
    out = np.zeros(len(own))
    branch_out = np.r_[n.branch_out, n.branch_bias[None]]
    sizes = leaf_counts(n)
    branches, small, leaves = n.branch[own], column_sums(branch_out) <= LARGEST, {}
    order = np.argsort(branches.astype(np.uint16), kind="stable")  # by branch, so that a branch's words are one product
    rooms = np.ones((step, len(n.bias) + 1), np.float32), np.empty((step, len(n.bias)), np.float32)
    for a in range(0, len(own), step):  # few words at once, which stay in the processor's cache
        part = order[a : a + step]
        h, room = (x[: len(part)] for x in rooms)
        hidden(n, window.take(part, axis=1), h, room)
        branch, leaf = branches.take(part), n.leaf.take(own.take(part))
        logs = _logs(h, branch_out, branch, small)
        cuts = [0, *(np.flatnonzero(np.diff(branch)) + 1).tolist(), len(part)]
        for u, v in zip(cuts[:-1], cuts[1:], strict=True):
            b = int(branch[u])
            if sizes[b] > 1:
                if b not in leaves:
                    table = np.r_[n.leaf_out[b][:, : sizes[b]], n.leaf_bias[b][None, : sizes[b]]]
                    leaves = {b: (table, column_sums(table) <= LARGEST)}  # the words are in the order of branches
                logs[u:v] += _logs(h[u:v], leaves[b][0], leaf[u:v], leaves[b][1])
        out[part] = logs
    return out


def leaf_counts(n: Network) -> np.ndarray:
    """How many classes each branch has."""
    return np.bincount(n.branch[1:], minlength=len(n.branch_bias))


def new_network(class_counts: np.ndarray, width: int, rng: np.random.Generator) -> Network:
    """A network that predicts classes by their counts; classes of like frequency share a branch."""
    number = len(class_counts) - 1  # the border is never predicted
    order = 1 + np.argsort(-class_counts[1:], kind="stable")
    shares = class_counts[order] + 0.1
    # branches + leaves looked at for a word are fewest when a class takes the root of its share of a branch
    taken = np.sqrt(np.maximum(shares / shares.sum(), 1 / (16 * number)))
    turn = np.unique((np.cumsum(taken) - taken).astype(np.int64), return_inverse=True)[1]
    size, leaves = int(turn[-1]) + 1, int(np.bincount(turn).max())
    branch, leaf = np.zeros(number + 1, np.int64), np.zeros(number + 1, np.int64)
    branch[order] = turn
    leaf[order] = np.arange(number) - np.searchsorted(turn, turn)
    weight = np.zeros((size, leaves))
    weight[branch[1:], leaf[1:]] = class_counts[1:] + 0.1
    small = lambda *shape: rng.normal(0, 0.1, shape).astype(np.float32)
    logs = lambda x: np.log(np.maximum(x, 1e-16)).astype(np.float32)
    return Network(
        small(2 * REACH, number + 1, width), np.zeros(width, np.float32), branch, leaf, small(width, size) * 0.1, logs(weight.sum(axis=1) / weight.sum()),
        small(size, width, leaves) * 0.1, logs(weight / weight.sum(axis=1, keepdims=True)),
    )


class Weights(NamedTuple):
    """A network's parameters, or sums of their squared gradients; in branch and leaves (one for each branch) the last row is the bias."""

    places: np.ndarray
    bias: np.ndarray
    branch: np.ndarray
    leaves: list[np.ndarray]

    def tables(self) -> list[np.ndarray]:
        """Views of all of it as tables, a row being what is averaged together."""
        return [self.places.reshape(-1, self.places.shape[-1]), self.bias.reshape(1, -1), self.branch.reshape(1, -1), *[x.reshape(1, -1) for x in self.leaves]]


def row_sums(values: np.ndarray, numbers: np.ndarray, many: int = 64) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct numbers, how many rows of values have each, and the sums of these rows.

    Numbers of `many` rows or more are summed one by one, all others together: their first rows, their second ones, and so on.
    """
    order = np.argsort(numbers, kind="stable")
    ordered = numbers.take(order)
    first = np.r_[0, np.flatnonzero(ordered[1:] != ordered[:-1]) + 1] if len(order) else np.zeros(0, np.int64)
    sizes = np.diff(np.r_[first, len(order)])
    by = np.argsort((many - np.minimum(sizes, many)).astype(np.uint16), kind="stable")  # those of most rows first
    first, sizes = first[by], sizes[by]
    left = np.cumsum(np.bincount(np.minimum(sizes, many), minlength=many + 1)[::-1])[::-1].tolist()  # how many have k rows or more
    sums = values.take(order.take(first), axis=0)
    whole = left[many]
    for k, (a, n) in enumerate(zip(first[:whole].tolist(), sizes[:whole].tolist(), strict=True)):
        np.matmul(np.ones(n, values.dtype), values.take(order[a : a + n], axis=0), out=sums[k])
    for k in range(1, many - 1):
        if left[k + 1] == whole:
            break
        sums[whole : left[k + 1]] += values.take(order.take(first[whole : left[k + 1]] + k), axis=0)
    return ordered.take(first).astype(np.int64), sizes, sums


class Learner:
    """Adagrad on the cross-entropy of each word's class in its window."""

    #: Rows of an output that are taken at once, which stay in the processor's cache.
    ROWS = 1024

    def __init__(self, network: Network, rate: float = 0.08, grown: Weights | None = None):
        self.shape, self.rate = network, rate
        leaves = [np.r_[network.leaf_out[b][:, :k], network.leaf_bias[b][None, :k]] for b, k in enumerate(leaf_counts(network).tolist())]
        self.weights = Weights(network.places.copy(), network.bias.copy(), np.r_[network.branch_out, network.branch_bias[None]], leaves)
        full = lambda x: np.full(x.shape, 0.1, np.float32)
        self.grown = Weights(full(network.places[:, :, 0]), full(network.bias), full(self.weights.branch), [full(x) for x in leaves])  # an embedding has one rate
        if grown is not None:
            self.grown = Weights(grown.places.copy(), grown.bias.copy(), grown.branch.copy(), [x.copy() for x in grown.leaves])
        self.seen = [np.zeros(len(x), np.int64) for x in self.weights.tables()]
        # a parameter changes by the rate at most in a step, so sums of absolute values need not be taken every time
        self.most = dict.fromkeys(range(-1, len(leaves)), np.inf)
        self.room = np.ones((self.ROWS, len(network.bias) + 1), np.float32)

    def _small(self, which: int, out: np.ndarray) -> bool:
        """Whether no exponential of an output (a branch's leaves; -1: the branches) can be out of range, the hidden layer being between -1 and 1."""
        self.most[which] += len(out) * self.rate
        if self.most[which] > LARGEST:
            self.most[which] = column_sums(out)
        return self.most[which] <= LARGEST

    @property
    def network(self) -> Network:
        n, w = self.shape, self.weights
        leaf_out, leaf_bias = n.leaf_out.copy(), n.leaf_bias.copy()
        for b, x in enumerate(w.leaves):
            leaf_out[b][:, : x.shape[1]], leaf_bias[b][: x.shape[1]] = x[:-1], x[-1]
        return Network(w.places, w.bias, n.branch, n.leaf, w.branch[:-1], w.branch[-1], leaf_out, leaf_bias)

    def _errors(self, out: np.ndarray, small: bool, h: np.ndarray, wanted: np.ndarray, back: np.ndarray) -> np.ndarray:
        """The gradient of one output; that of what it was given is put into `back`; small: none of its exponentials is out of range."""
        gradient, ones, columns = None, np.ones(out.shape[1], np.float32), out.shape[1]
        room = np.empty((min(len(h), self.ROWS), columns), np.float32)
        for a in range(0, len(h), self.ROWS):
            part = h[a : a + self.ROWS]
            error = np.matmul(part, out, out=room[: len(part)])
            if not small:
                error -= error.max(axis=1, keepdims=True)
            np.exp(error, out=error)
            total = error @ ones
            error *= (1 / total)[:, None]
            error.reshape(-1)[np.arange(0, error.size, columns) + wanted[a : a + self.ROWS]] -= 1
            np.matmul(error, out[:-1].T, out=back[a : a + self.ROWS])
            more = part.T @ error
            gradient = more if gradient is None else np.add(gradient, more, out=gradient)
        return gradient

    def _follow(self, out: np.ndarray, grown: np.ndarray, gradient: np.ndarray) -> None:
        """One step of parameters against their gradient, which is used up."""
        square = gradient * gradient
        grown += square
        gradient /= np.sqrt(grown, out=square)
        gradient *= self.rate
        out -= gradient

    def step(self, window: np.ndarray, own: np.ndarray) -> None:
        n, w = self.shape, self.weights
        order = np.argsort(n.branch[own].astype(np.uint16), kind="stable")
        window, own = window.take(order, axis=1), own.take(order)
        branch, leaf = n.branch.take(own), n.leaf.take(own)
        cuts = np.r_[0, np.flatnonzero(np.diff(branch)) + 1, len(own)]
        back, gradient, small = np.empty((len(own), len(w.bias)), np.float32), np.zeros_like(w.branch), self._small(-1, w.branch)
        at = 0
        while at < len(cuts) - 1:  # whole branches, of few words at once, which stay in the processor's cache
            upto = max(at + 1, int(np.searchsorted(cuts, cuts[at] + self.ROWS, "right")) - 1)
            begin, end = int(cuts[at]), int(cuts[upto])
            mine = back[begin:end]
            if end - begin > len(self.room):
                self.room = np.ones((end - begin, len(w.bias) + 1), np.float32)
            h = self.room[: end - begin]  # its last column stays
            hidden(w, window[:, begin:end], h, mine)
            gradient += self._errors(w.branch, small, h, branch[begin:end], mine)
            for u, v in zip((cuts[at:upto] - begin).tolist(), (cuts[at + 1 : upto + 1] - begin).tolist(), strict=True):
                b = int(branch[begin + u])
                self.seen[3 + b] += v - u
                out = w.leaves[b]
                if out.shape[1] > 1:
                    below = np.empty((v - u, len(w.bias)), np.float32)
                    change = self._errors(out, self._small(b, out), h[u:v], leaf[begin + u : begin + v], below)
                    mine[u:v] += below
                    self._follow(out, self.grown.leaves[b], change)
            slope = h[:, :-1] * h[:, :-1]
            mine *= np.subtract(1, slope, out=slope)
            at = upto
        self._follow(w.branch, self.grown.branch, gradient)
        self._follow(w.bias, self.grown.bias, back.sum(axis=0))
        for k in (1, 2):
            self.seen[k] += len(own)
        classes = w.places.shape[1]
        for k in range(len(window)):
            rows, sizes, gradient = row_sums(back, window[k])
            grown = self.grown.places[k].take(rows) + np.einsum("ij,ij->i", gradient, gradient) / len(w.bias)
            self.grown.places[k][rows] = grown
            gradient *= (self.rate / np.sqrt(grown))[:, None]
            w.places[k][rows] -= gradient
            self.seen[0][k * classes + rows] += sizes

    def read(self, own: np.ndarray, counts: np.ndarray, batch: int, rng: np.random.Generator) -> None:
        """Go once through the classes of some texts, in random order."""
        own = narrow(own, self.weights.places.shape[1])
        window = windows(own, counts)
        shuffled = rng.permutation(len(own))
        for a in range(0, len(own), batch):
            part = shuffled[a : a + batch]
            self.step(window.take(part, axis=1), own.take(part))


def train_network(sequences: list[np.ndarray], class_counts: np.ndarray, *, width: int = 32, epochs: int = 3, batch: int = 4096, rate: float = 0.08, seed: int = 7) -> Network:
    """A network that has gone through sequences (classes, text by text) several times."""
    return begun(sequences, class_counts, width=width, epochs=epochs, batch=batch, rate=rate, seed=seed).network


def begun(sequences: list[np.ndarray], class_counts: np.ndarray, *, width: int = 32, epochs: int = 3, batch: int = 4096, rate: float = 0.08, seed: int = 7) -> Learner:
    rng = np.random.default_rng(seed)
    learner = Learner(new_network(class_counts, width, rng), rate)
    for _ in range(epochs if sequences else 0):
        learner.read(np.concatenate(sequences), np.array([len(s) for s in sequences]), batch, rng)
    return learner


#: Blocks of rows of the parameters are numbered from 0 on, parts of the letter counts from -1 down.
LEARNED = "block int, learner int, sums binary, seen binary"
LETTERS_EACH = 1 << 15


def train_on_all(docs: DataFrame, text_col: str, classes: Classes, learner: Learner, tokens: float, **how: int) -> Network:
    """The network after every word of docs, as read_all trains it."""
    return read_all(docs, text_col, classes, learner, tokens, **how)[0]


def read_all(docs: DataFrame, text_col: str, classes: Classes, learner: Learner, tokens: float, *, tokens_each: int = 16_000_000, batch: int = 32_768, block_rows: int = 512) -> tuple[Network, np.ndarray]:
    """The network after every word of docs, and by letter code how often the words without a class of their own have it.

    Each task goes once through its texts, from the learner given.
    Of each row of the parameters the tasks' changes are averaged, weighted by how many words they had
    for it. A task is for about tokens_each words or a partition; it sends no more than one set of parameters.
    A word's letters count once for each slice of texts that has it; a code is the three letters after and the letter, CODES**4 in all.
    """
    spark = docs.sparkSession
    given = spark.sparkContext.broadcast((classes, learner.network, learner.grown, learner.rate))

    def learn(batches):
        from pyspark import TaskContext

        known, network, grown, rate = given.value
        here, number = Learner(network, rate, grown), TaskContext.get().partitionId()
        rng = np.random.default_rng(number)
        before = [x.copy() for x in here.weights.tables()]
        letters = np.zeros(CODES**4, np.int64)
        for arrow in batches:
            for a, b in row_slices(arrow.column(0)):
                part = spelled(arrow.column(0)[a:b])
                hashes = hash_words(part.words)
                own = known.of(hashes, part.endings)
                here.read(own, part.words.counts, batch, rng)
                rare = np.flatnonzero(own > len(known.hashes))
                order, first = grouped(hashes[rare])
                rare = rare[order[first]]
                context, letter, _ = part.steps(rare[part.words.ends[rare] - part.words.starts[rare] > 1])
                np.add.at(letters, context * CODES + letter, 1)
        for k in range(len(letters) // LETTERS_EACH):
            n = letters[k * LETTERS_EACH : (k + 1) * LETTERS_EACH]
            if n.any():
                yield pa.RecordBatch.from_pydict({"block": pa.array([-1 - k], pa.int32()), "learner": pa.array([number], pa.int32()), "sums": pa.array([n.tobytes()]), "seen": pa.array([b""])})
        block = 0
        for old, new, seen in zip(before, here.weights.tables(), here.seen, strict=True):
            for a in range(0, len(new), block_rows):
                n = seen[a : a + block_rows]
                if n.any():
                    sums = (new[a : a + block_rows] - old[a : a + block_rows]) * n[:, None].astype(np.float64)
                    yield pa.RecordBatch.from_pydict({"block": pa.array([block], pa.int32()), "learner": pa.array([number], pa.int32()), "sums": pa.array([sums.astype(np.float32).tobytes()]), "seen": pa.array([n.tobytes()])})
                block += 1

    def summed(batches):
        """Of each block, whose rows come one after the other, the sums."""
        held, sums, seen = None, None, None

        def row():
            out = sums if held < 0 else (sums / np.maximum(seen, 1).repeat(len(sums) // len(seen))).astype(np.float32)
            return pa.RecordBatch.from_pydict({"block": pa.array([held], pa.int32()), "learner": pa.array([0], pa.int32()), "sums": pa.array([out.tobytes()]), "seen": pa.array([seen.tobytes()])})

        for arrow in batches:
            for block, x, n in zip(arrow.column(0).to_pylist(), arrow.column(2), arrow.column(3), strict=True):
                x, n = np.frombuffer(x.as_buffer(), np.int64 if block < 0 else np.float32), np.frombuffer(n.as_buffer(), np.int64)
                if block != held:
                    if held is not None:
                        yield row()
                    held, sums, seen = block, np.zeros(len(x), np.int64 if block < 0 else np.float64), np.zeros(len(n), np.int64)
                sums, seen = sums + x, seen + n
        if held is not None:
            yield row()

    tasks = max(spark.sparkContext.defaultParallelism, math.ceil(tokens / tokens_each))
    learned = docs.select(F.col(text_col).cast("binary").alias("text")).coalesce(tasks).mapInArrow(learn, LEARNED)
    means = learned.repartition("block").sortWithinPartitions("block", "learner").mapInArrow(summed, LEARNED)
    changes = {r.block: np.frombuffer(r.sums, np.int64 if r.block < 0 else np.float32) for r in means.select("block", "sums").collect()}  # one set of parameters and CODES**4 counts
    letters = np.concatenate([changes.get(-1 - k, np.zeros(LETTERS_EACH, np.int64)) for k in range(CODES**4 // LETTERS_EACH)])
    block = 0
    for table in learner.weights.tables():
        for a in range(0, len(table), block_rows):
            if block in changes:
                table[a : a + block_rows] += changes[block].reshape(-1, table.shape[1])
            block += 1
    return learner.network, letters


def grouped(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order in which equal hashes stand together, and where in it each of the different ones begins."""
    order = np.argsort(hashes)
    ordered = hashes.take(order)
    new = np.ones(len(order), bool)
    new[1:] = ordered[1:] != ordered[:-1]
    return order, np.flatnonzero(new)


def word_counts(docs: DataFrame, text_col: str, flush: int = 1 << 21) -> DataFrame:
    """hash, ending and n of every word of all documents."""

    def merged(held: list[np.ndarray]) -> pa.RecordBatch:
        hashes, endings, n = (np.concatenate(x) for x in zip(*held, strict=True))
        order, first = grouped(hashes)
        at = order[first]
        n = np.diff(np.r_[0, np.cumsum(n[order])][np.r_[first, len(order)]])
        return pa.RecordBatch.from_arrays([pa.array(hashes[at].view(np.int64)), pa.array(endings[at], pa.int32()), pa.array(n)], ["hash", "ending", "n"])

    def count(batches):
        held, size = [], 0
        for batch in batches:
            for a, b in row_slices(batch.column(0)):
                part = spelled(batch.column(0)[a:b])
                hashes = hash_words(part.words)
                order, first = grouped(hashes)
                held.append((hashes[order[first]], part.endings[order[first]], np.diff(np.r_[first, len(order)])))
                size += len(first)
                if size > flush:
                    yield merged(held)
                    held, size = [], 0
        if held:
            yield merged(held)

    rows = docs.select(F.col(text_col).cast("binary").alias("text")).mapInArrow(count, "hash bigint, ending int, n bigint")
    return rows.groupBy("hash").agg(F.min("ending").alias("ending"), F.sum("n").alias("n"))


def letter_model(n: np.ndarray) -> np.ndarray:
    """Log-probability of a letter before three others, interpolated, from the counts that read_all gives."""
    n = n.reshape(CODES, CODES, CODES, CODES)  # the next letter, the one after, a third, and the letter itself
    out = np.full(CODES, 1 / CODES)
    for axes in ((0, 1, 2), (1, 2), (2,), ()):
        m = n.sum(axis=axes, keepdims=True) if axes else n
        total = m.sum(axis=-1, keepdims=True)
        share = total / (total + 5.0)
        out = share * (m / np.maximum(total, 1)) + (1 - share) * out
    return np.log(np.broadcast_to(out, n.shape)).astype(np.float32).reshape(CODES**3, CODES)


def learn_model(docs: DataFrame, text_col: str = "text", *, own_words: int = 16_384, sample_tokens: int = 1_000_000, sample_cut: int = 20_000, width: int = 32, epochs: int = 3) -> tuple[Model, DataFrame]:
    """The model of a corpus and its word counts (hash, n).

    Words, endings and letters are counted over all documents, and the network is trained on all their
    words (read_all). Where that begins comes from about sample_tokens tokens, those of documents drawn
    by a hash of their text, copies once, and of one document no more than sample_cut.
    """
    scratch = Scratch(docs.sparkSession, "pseudo-likelihood")
    counts = scratch.store(word_counts(docs, text_col), "word-counts")
    top = counts.orderBy(F.desc("n"), "hash").limit(own_words).collect()
    hashes = np.array([r.hash for r in top], np.int64).view(np.uint64)
    order = np.argsort(hashes)
    classes = Classes(hashes[order], (1 + np.arange(len(hashes)))[order])
    rest = counts.join(F.broadcast(docs.sparkSession.createDataFrame([(r.hash,) for r in top], "hash bigint")), "hash", "left_anti")  # own_words rows
    by_ending = {r.ending: r for r in rest.groupBy("ending").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("types")).collect()}
    tokens, types = ([int(getattr(by_ending[e], k)) if e in by_ending else 0 for e in range(ENDINGS)] for k in ("n", "types"))
    class_counts = np.r_[0.0, [r.n for r in top], tokens]

    share = min(1.0, sample_tokens / max(1.0, class_counts.sum()))
    shared = docs.sparkSession.sparkContext.broadcast(classes)

    def sequences(batches):
        for batch in batches:
            for a, b in row_slices(batch.column(0)):
                part = spelled(batch.column(0)[a:b])
                own = shared.value.of(hash_words(part.words), part.endings).astype(np.int32)
                cut = np.minimum(part.words.counts, sample_cut)
                starts = np.cumsum(part.words.counts) - part.words.counts
                keep = np.repeat(starts - (np.cumsum(cut) - cut), cut) + np.arange(int(cut.sum()))
                yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(cut)].astype(np.int32)), pa.array(own[keep]))], ["classes"])

    drawn = docs.select(F.col(text_col).cast("binary").alias("text"), F.xxhash64(F.col(text_col)).alias("key"))
    drawn = drawn.where(F.pmod("key", F.lit(1 << 30)) / float(1 << 30) < share).dropDuplicates(["key"]).select("text")
    sample = drawn.mapInArrow(sequences, "classes array<int>").toArrow()["classes"].combine_chunks()  # about sample_tokens numbers
    at = sample.offsets.to_numpy() if len(sample) else np.zeros(1, np.int32)
    values = sample.values.to_numpy().astype(np.int64) if len(sample) else np.zeros(0, np.int64)
    parts = [values[a:b] for a, b in zip(at[:-1], at[1:], strict=True) if b > a]
    learner = begun(parts, class_counts, width=width, epochs=epochs)
    network, letters = read_all(docs, text_col, classes, learner, class_counts.sum())
    return Model(classes, network, letter_model(letters), tokens, types), counts.select("hash", "n")


SCORED = "id bigint, row bigint, hash bigint, ending int, n bigint, value double"


def scored_words(docs: DataFrame, model: Model, id_col: str, text_col: str) -> DataFrame:
    """Rows of SCORED: for each row of docs one with ending -1, its tokens and the sum of class log-probabilities,

    and one for each distinct word without a class of its own: how often the text has it and the log-probability of its spelling.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the number of classes and CODES**4

    def score(batches):
        m = shared.value
        for batch in batches:
            for a, b in row_slices(batch.column(2)):
                part = spelled(batch.column(2)[a:b])
                counts, hashes, endings = part.words.counts, hash_words(part.words), part.endings
                own = m.classes.of(hashes, endings)
                logs = class_logs(m.network, windows(narrow(own, m.classes.number), counts), own)
                full = counts > 0
                sums = np.zeros(len(counts))
                if len(own):
                    sums[full] = np.add.reduceat(logs, (np.cumsum(counts) - counts)[full])
                text = np.repeat(np.arange(len(counts)), counts)
                rare = np.flatnonzero(own > len(m.classes.hashes))
                order = rare[np.lexsort((hashes[rare], text[rare]))]
                new = np.ones(len(order), bool)
                new[1:] = (hashes[order[1:]] != hashes[order[:-1]]) | (text[order[1:]] != text[order[:-1]])
                first = np.flatnonzero(new)
                n = np.diff(np.r_[first, len(order)])
                word = order[first]
                i, row = batch.column(0)[a:b], batch.column(1)[a:b]
                whole = [i, row, pa.array(mixed(row.to_numpy().view(np.uint64)).view(np.int64)), pa.array(np.full(len(counts), -1), pa.int32()), pa.array(counts, pa.int64()), pa.array(sums)]
                at = pa.array(text[word])
                each = [pa.nulls(len(word), pa.int64()), row.take(at), pa.array(hashes[word].view(np.int64)), pa.array(endings[word], pa.int32()), pa.array(n, pa.int64()), pa.array(spelling_logs(part, m.letters, word))]
                for columns in (whole, each):
                    yield pa.RecordBatch.from_arrays(columns, ["id", "row", "hash", "ending", "n", "value"])

    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.monotonically_increasing_id().alias("row"), F.col(text_col).cast("binary").alias("text"))
    return rows.mapInArrow(score, SCORED)


def score_documents(docs: DataFrame, model: Model, counts: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, own_left_out: bool = True) -> DataFrame:
    """One row for each row of docs: id, n_tokens, log_likelihood (summed), mean (per token), known.

    counts: words of the corpus as learn_model returns them. own_left_out: docs are the
    corpus, so a document's own words are taken off the counts. known: the share of its
    words without a class of their own that the rest of the corpus has; null if there are none.
    """
    tokens, types = (F.array(*[F.lit(float(x)) for x in v]) for v in (model.tokens, model.types))
    words = scored_words(docs, model, id_col, text_col).join(counts.select("hash", F.col("n").alias("corpus")), "hash", "left")
    word = F.col("ending") >= 0
    taken = F.col("n") if own_left_out else F.lit(0)
    others = F.greatest(F.coalesce("corpus", F.lit(0)) - taken, F.lit(0))
    prior = F.get(types, F.col("ending")) + 1.0
    among = F.greatest(F.get(tokens, F.col("ending")) - taken, F.lit(0.0)) + prior
    log_word = F.col("n") * F.log((others + prior * F.exp("value")) / among)
    sums = words.select("row", "id", word.alias("word"), "n", F.when(word, log_word).otherwise(F.col("value")).alias("log"), F.when(word & (others > 0), F.col("n")).otherwise(0).alias("elsewhere"))
    by_row = sums.groupBy("row").agg(
        F.max("id").alias("id"),
        F.sum(F.when(~F.col("word"), F.col("n"))).alias("n_tokens"),
        F.sum("log").alias("log_likelihood"),
        F.sum(F.when(F.col("word"), F.col("n"))).alias("rare"),
        F.sum("elsewhere").alias("elsewhere"),
    )
    mean = F.when(F.col("n_tokens") > 0, F.col("log_likelihood") / F.col("n_tokens"))
    return by_row.select(F.col("id").alias(id_col), "n_tokens", "log_likelihood", mean.alias("mean"), (F.col("elsewhere") / F.col("rare")).alias("known"))
