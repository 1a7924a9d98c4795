import random
import struct

import numpy as np
import pyarrow as pa
import pytest

from mergeloom.operators import sequence
from mergeloom.operators.batches import MergeTable, Trie
from mergeloom.sources import model_io
from mergeloom.sources.storage import Scratch


def plain_merges(data, target, self_pair):
    symbols, merges = list(data), []
    while 256 + len(merges) < target:
        counts = {}
        for pair in zip(symbols, symbols[1:]):
            if 0 not in pair:
                counts[pair] = counts.get(pair, 0) + 1
        pair = min(counts, key=lambda p: (-counts[p], p), default=None)
        if pair is None or counts[pair] < 2:
            break
        merges.append((*pair, 256 + len(merges), counts[pair]))
        symbols = plain_merged(symbols, *merges[-1][:3], self_pair)
    return merges


def plain_merged(symbols, a, b, new, self_pair):
    out, k = [], 0
    while k < len(symbols):
        if symbols[k : k + 2] == [a, b]:
            k += 2
            while a == b and self_pair == "collapse" and k < len(symbols) and symbols[k] == a:
                k += 1
            out.append(new)
        else:
            out.append(symbols[k])
            k += 1
    return out


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(2)
    return ["".join(rng.choice("aab \n") for _ in range(rng.randint(0, 60))) for _ in range(12)] + ["a" * 150, "b" * 37 + "a" * 41, None, "", "x\0y\0x\0y"]


@pytest.fixture(scope="module")
def docs(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(3)


@pytest.fixture(scope="module")
def joined(texts):
    return "\n\n".join(t for t in texts if t is not None).encode()


def test_pieces_are_the_sequence(spark, docs, joined):
    rows = sequence.corpus_pieces(docs, "doc_id", size=7, scratch=Scratch(spark, "t")).orderBy("piece").collect()
    assert [bytes(r.bytes) for r in rows] == [joined[a : a + 7] for a in range(0, len(joined), 7)]


@pytest.mark.parametrize(("size", "self_pair"), [(5, "greedy"), (5, "collapse"), (1000, "greedy")])
def test_merges_across_pieces(docs, joined, size, self_pair, monkeypatch):
    monkeypatch.setattr(sequence, "BLOCK", 3)
    got = sequence.train_sequence(docs, 256 + 10, "doc_id", size=size, self_pair=self_pair)
    assert [tuple(m) for m in got] == plain_merges(joined, 256 + 10, self_pair)


def test_no_text(spark):
    assert sequence.train_sequence(spark.createDataFrame([(1, "")], "doc_id bigint, text string"), 260, "doc_id") == []


def test_chunks_and_export_of_a_corpus(spark, docs, joined, tmp_path, monkeypatch):
    monkeypatch.setattr(sequence, "BLOCK", 3)
    vocabulary = [bytes([k]) for k in range(256)] + [b"aa", b"ab", b"a a", b" \n"]
    ids, ends, _ = Trie(vocabulary).encode(np.frombuffer(joined, np.uint8), np.array([0, len(joined)]), 16)
    encoded = sequence.encode_corpus(docs, vocabulary, "doc_id", size=16, chunks_in_piece=3, scratch=Scratch(spark, "t"))
    rows = sorted(tuple(r) for r in sequence.corpus_chunks(encoded).collect())
    assert rows == [(k, int(b - a), int(a)) for k, (a, b) in enumerate(zip(ends[:-1], ends[1:], strict=True))]

    folder = f"{tmp_path}/export"
    assert model_io.export_corpus(encoded, '{"vocab":[]}', len(vocabulary), folder) == len(ids)
    files = sorted(tmp_path.glob("export/*/part-*"))
    whole = b"".join(f.read_bytes() for f in files)
    assert whole == struct.pack("<4I", model_io.EXPORT_MAGIC, len(vocabulary), len(ids), 12) + ids.astype("<u4").tobytes() + b'{"vocab":[]}'
    assert model_io.parse_token_blob(whole) == (len(vocabulary), ids.tolist(), '{"vocab":[]}')
    back = sorted((r.position, r.tokens) for r in model_io.read_export(spark, folder, most=50).collect())
    assert [t for _, part in back for t in part] == ids.tolist() and [p for p, _ in back] == list(np.cumsum([0] + [len(t) for _, t in back[:-1]]))
    next(f for f in files if "1-tokens" in str(f) and f.stat().st_size).unlink()
    with pytest.raises(ValueError, match="ids instead of"):
        model_io.read_export(spark, folder)
    with pytest.raises(ValueError, match="not a token export"):
        model_io.read_export(spark, _other(spark, tmp_path))


def _other(spark, path):
    spark.createDataFrame([("x",)], "value string").write.text(f"{path}/other/0-header")
    return f"{path}/other"


def test_rows_and_places_merge_alike():
    rng = np.random.default_rng(3)
    for _ in range(300):
        rows = [rng.integers(1, 4, rng.integers(0, 14)).tolist() for _ in range(rng.integers(0, 6))]
        offsets = np.r_[0, np.cumsum([len(r) for r in rows])].astype(np.int64)
        ids = np.array([s for r in rows for s in r], np.int32)
        merges, symbols = [], [1, 2, 3]
        for k in range(rng.integers(0, 6)):
            pair = (int(rng.choice(symbols)), int(rng.choice(symbols)))
            if pair not in [m[:2] for m in merges]:
                merges.append((*pair, 256 + len(merges)))
                symbols.append(merges[-1][2])
        for self_pair in ("greedy", "collapse"):
            want = rows
            for m in merges:
                want = [plain_merged(r, *m, self_pair) for r in want]
            table = MergeTable(merges, self_pair)
            for apply in (table.apply, table.apply_rows):
                out, at = apply(ids, offsets)
                assert [out[a:b].tolist() for a, b in zip(at[:-1], at[1:], strict=True)] == want


def test_chunks_do_not_read_the_ids(spark, docs):
    vocabulary = [bytes([k]) for k in range(256)] + [b"aa"]
    encoded = sequence.encode_corpus(docs, vocabulary, "doc_id", size=16, chunks_in_piece=3, scratch=Scratch(spark, "t"))
    plan = sequence.corpus_chunks(encoded)._jdf.queryExecution().executedPlan().toString()
    assert "sizes:array<int>" in plan and "chunks:array" not in plan
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


def test_edges_of_pieces_in_slices(spark, monkeypatch):
    from mergeloom.operators import batches

    monkeypatch.setattr(batches.slices, "__defaults__", (3,))
    rows = [(0, [5]), (1, [5, 5, 5]), (2, [1, 5, 5]), (3, [2, 7]), (4, [7, 7, 7, 7, 7])]
    got = sequence._edges(spark.createDataFrame(rows, "piece bigint, ids array<int>").coalesce(1)).orderBy("piece").collect()
    assert [tuple(r) for r in got] == [(0, 5, 5, 1, 1), (1, 5, 5, 3, 3), (2, 1, 5, 3, 2), (3, 2, 7, 2, 1), (4, 7, 7, 5, 5)]
    cut = list(batches.batch_slices(iter([pa.RecordBatch.from_pydict({"piece": [r[0] for r in rows], "ids": [r[1] for r in rows]})]), 1))
    assert max(len(b) for b in cut) <= 2 and pa.Table.from_batches(cut)["piece"].to_pylist() == list(range(5))


def test_files_of_an_export_do_not_grow(spark, docs, joined, tmp_path):
    vocabulary = [bytes([k]) for k in range(256)]
    encoded = sequence.encode_corpus(docs, vocabulary, "doc_id", size=16, chunks_in_piece=3, scratch=Scratch(spark, "t"))
    assert model_io.export_corpus(encoded, "{}", 256, f"{tmp_path}/e", file_ids=100) == len(joined)
    files = [f for f in sorted(tmp_path.glob("e/1-tokens/part-*")) if f.stat().st_size]
    assert len(files) >= len(joined) // 150 and max(f.stat().st_size for f in files) <= 4 * 150
    assert b"".join(f.read_bytes() for f in files) == np.frombuffer(joined, np.uint8).astype("<u4").tobytes()
    back = sorted((r.position, r.tokens) for r in model_io.read_export(spark, f"{tmp_path}/e").collect())
    assert [t for _, part in back for t in part] == list(joined)


def test_pieces_are_cut_where_they_are_read():
    data = bytes(range(7, 207))

    def rows(*bounds):
        return iter([pa.RecordBatch.from_pydict({"place": pa.array([a], pa.int64()), "bytes": [data[a:b]]}) for a, b in bounds])

    for total in (200, 195, 1):
        for bounds in ([(0, 200)], [(0, 3), (3, 90), (90, 200)], [(90, 200), (0, 33), (33, 90)], [(k, k + 1) for k in range(200)]):
            whole, loose = {}, {}
            for pieces, places, parts in sequence.cut_pieces(rows(*bounds), 16, total):
                for k, piece in enumerate(pieces):
                    if places is None:
                        whole[piece] = parts[k]
                    else:
                        loose.setdefault(piece, []).append((places[k], parts[k]))
            assert len(loose) <= len(bounds) + 1 and (len(bounds) == 200 or sum(map(len, loose.values())) <= 4)
            whole |= {piece: b"".join(p for _, p in sorted(parts)) for piece, parts in loose.items()}
            assert [whole[k] for k in sorted(whole)] == [data[a : min(a + 16, total)] for a in range(0, total, 16)]


def test_a_round_reads_the_sequence_as_bytes_and_few_neighbours(spark, docs, joined, monkeypatch):
    seen = {}
    store = Scratch.store

    def spied(self, df, name, **options):
        out = store(self, df, name, **options)
        seen.setdefault(name, []).append((out.dtypes, out.count()))
        return out

    monkeypatch.setattr(Scratch, "store", spied)
    assert [tuple(m) for m in sequence.train_sequence(docs, 256 + 3, "doc_id", size=8)] == plain_merges(joined, 256 + 3, "greedy")
    assert len(seen["sequence"]) <= 3 and all(("symbols", "binary") in kinds and "array" not in str(kinds) for kinds, _ in seen["sequence"])
    assert all(n < around for (_, n), (_, around) in zip(seen["touched"], seen["around"], strict=False))


def test_merges_in_one_go_are_merges_one_by_one():
    rng = np.random.default_rng(5)
    for _ in range(500):
        ids = rng.integers(0, 5, rng.integers(1, 30)).astype("<u2")
        merges = [sequence.Merge(1, 2, 256, 9), sequence.Merge(4, 3, 257, 9)][: rng.integers(1, 3)] if rng.random() < 0.5 else [sequence.Merge(int(a := rng.integers(1, 4)), int(a), 256, 9)]
        for self_pair in ("greedy", "collapse"):
            want = ids.tolist()
            for m in merges:
                want = plain_merged(want, *m[:3], self_pair)
            assert sequence.Replacing(merges, self_pair).apply(ids).tolist() == want


@pytest.mark.parametrize("most", [1 << 20, 10])
def test_pairs_counted_by_table_and_by_sorting(most):
    rng = np.random.default_rng(6)
    want, counts, got = {}, sequence.PairCounts(7, most), {}
    for _ in range(40):
        rows = [rng.integers(0, 7, rng.integers(1, 9)) for _ in range(rng.integers(1, 5))]
        for row in rows:
            for pair in zip(row.tolist(), row.tolist()[1:]):
                if 0 not in pair:
                    want[pair] = want.get(pair, 0) + 1
        counts.add(np.concatenate(rows).astype("<u2"), np.r_[0, np.cumsum([len(r) for r in rows])])
        if counts.full() or _ == 39:
            for pair, n in zip(*[x.tolist() for x in counts.taken()], strict=True):
                got[pair >> 16, pair & 0xFFFF] = got.get((pair >> 16, pair & 0xFFFF), 0) + n
    assert got == want


def test_trie_in_a_table_and_by_search():
    rng = random.Random(7)
    for _ in range(200):
        vocabulary = [bytes(rng.choice(b"ab\0") for _ in range(rng.randint(0, 5))) for _ in range(rng.randint(0, 9))]
        text = bytes(rng.choice(b"abc\0") for _ in range(rng.randint(0, 80)))
        size, small, want = rng.randint(1, 30), rng.choice((0, 4096)), []
        for a in range(0, len(text), size):
            at, end = a, min(a + size, len(text))
            while at < end:
                found = max(((len(v), k) for k, v in enumerate(vocabulary) if v and text[at:end].startswith(v)), default=(1, text[at]))
                want.append(found[1])
                at += found[0]
        trie = type("Sized", (Trie,), {"SMALL": small})(vocabulary)
        assert trie.encode(np.frombuffer(text, np.uint8), np.array([0, len(text)]), size)[0].tolist() == want


def test_more_ids_than_a_header_counts_go_into_volumes(spark, docs, joined, tmp_path):
    vocabulary = [bytes([k]) for k in range(256)] + [b"aa"]
    ids, _, _ = Trie(vocabulary).encode(np.frombuffer(joined, np.uint8), np.array([0, len(joined)]), 16)
    encoded = sequence.encode_corpus(docs, vocabulary, "doc_id", size=16, chunks_in_piece=3, scratch=Scratch(spark, "t"))
    assert model_io.export_corpus(encoded, "{}", 257, f"{tmp_path}/v", file_ids=60, most_ids=200) == len(ids)
    volumes = sorted(tmp_path.glob("v/*"))
    found = [model_io.parse_token_blob(b"".join(f.read_bytes() for f in sorted(v.glob("*/part-*")))) for v in volumes]
    assert [v.name for v in volumes] == [f"volume-{k:05d}-of-{len(found):05d}" for k in range(len(found))] and len(found) == 1 + len(ids) // 200
    assert all((size, text) == (257, "{}") and 0 < len(part) <= 200 for size, part, text in found) and [t for _, part, _ in found for t in part] == ids.tolist()
    back = sorted((r.position, r.tokens) for r in model_io.read_export(spark, f"{tmp_path}/v", most=50).collect())
    assert [t for _, part in back for t in part] == ids.tolist() and [p for p, _ in back] == list(np.cumsum([0] + [len(t) for _, t in back[:-1]]))
    sums = sorted(tuple(r) for r in model_io.export_sums(spark, f"{tmp_path}/v", 70).collect())
    assert sums == [(k, len(part), sum((i + 1) * int(t) for i, t in enumerate(part))) for k in range(-(-len(ids) // 70)) for part in [ids[70 * k : 70 * k + 70]]]
    volumes[1].rename(tmp_path / "elsewhere")
    with pytest.raises(ValueError, match="volumes instead of"):
        model_io.read_export(spark, f"{tmp_path}/v")
    with pytest.raises(ValueError, match="a piece of"):
        model_io.export_corpus(encoded, "{}", 257, f"{tmp_path}/w", most_ids=20)


def test_headers_count_no_more_than_32_bits(spark, tmp_path):
    rows = [(0, 0, 3_000_000_000, 2, bytearray(8)), (1, 3_000_000_000, 3_000_000_000, 1, bytearray(4))]
    encoded = spark.createDataFrame(rows, "piece bigint, offset bigint, tokens bigint, width int, ids binary")
    assert model_io.export_corpus(encoded, "", 256, f"{tmp_path}/e", file_ids=1 << 32) == 6_000_000_000
    heads = [b"".join(f.read_bytes() for f in v.glob("0-header/part-*")) for v in sorted(tmp_path.glob("e/volume-*"))]
    assert [struct.unpack("<4I", h)[2] for h in heads] == [3_000_000_000] * 2
