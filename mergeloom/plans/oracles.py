"""DuckDB SQL for the queries of mergeloom.plans.queries, written independently of their expressions."""

from __future__ import annotations

from mergeloom.operators.permutation import ROUNDS
from mergeloom.plans.queries import K, LETTER_PAIRS
from mergeloom.sources.corpus import TEXT_EXTENSIONS

BYTE_WORDS = r"\n| *(?:[A-Za-z\x{80}-\x{10FFFF}]+|[0-9]+)| +|[^A-Za-z0-9 \n\x{80}-\x{10FFFF}]+"
SPACES = r"\t\x{0B}\x{0C} \x{A0}\x{1680}\x{2000}-\x{200A}\x{202F}\x{205F}\x{3000}"
NEWLINES = r"\n\r\x{85}\x{2028}\x{2029}"
CLASS_RE = {
    "LETTER": r"[\p{L}\p{M}]",
    "DIGIT": r"\p{N}",
    "WHITESPACE": f"[{SPACES}]",
    "PUNCTUATION": r"\p{P}",
    "SYMBOL": r"\p{S}",
    "NEWLINE": f"[{NEWLINES}]",
    "OTHER": rf"[^\p{{L}}\p{{M}}\p{{N}}\p{{P}}\p{{S}}{SPACES}{NEWLINES}]",
}
SYMBOLS_OF = "array_to_string(list_transform(regexp_extract_all(hex(encode({0})), '..'), lambda b: chr((65536 + ('0x' || b)::INT)::INT)), '')"


def _class_case(c: str) -> str:
    arms = " ".join(f"WHEN regexp_matches({c}, '{CLASS_RE[n]}') THEN {k}" for n, k in (("NEWLINE", 5), ("LETTER", 0), ("DIGIT", 1), ("WHITESPACE", 2), ("PUNCTUATION", 3), ("SYMBOL", 4)))
    return f"CASE {arms} ELSE 6 END"


def _swap_rounds() -> str:
    """A step for each round of the permutation: a number may change place with its mirror image about the round's key."""
    steps = []
    for k in range(ROUNDS):
        key = f"('0x' || substr(md5('42:{k}'), 1, 15))::BIGINT % n"
        steps.append(
            f"m{k} AS (SELECT *, ({key} + n - x) % n AS other FROM r{k}), "
            f"r{k + 1} AS (SELECT * EXCLUDE (x, other), CASE WHEN substr(md5('42:{k}:' || greatest(x, other)), 1, 1) >= '8' THEN other ELSE x END AS x FROM m{k})"
        )
    return ", ".join(steps)


BAG = f"""
bag AS MATERIALIZED (
  SELECT word, count(*) AS freq FROM (SELECT unnest(regexp_extract_all(text, '{BYTE_WORDS}')) AS word FROM documents) GROUP BY word
), s0 AS MATERIALIZED (SELECT word, freq, {SYMBOLS_OF.format("word")} AS s FROM bag)"""


def _pairs(source: str) -> str:
    return f"""SELECT p, sum(freq)::BIGINT AS n FROM (
      SELECT unnest(list_transform(range(1, length(s)), lambda i: substr(s, i, 2))) AS p, freq FROM {source} WHERE length(s) > 1
    ) WHERE NOT contains(p, chr(65536)) GROUP BY p"""


def _training() -> str:
    """Tables s0..sK of symbol strings, m0..m(K-1) of best pairs."""
    parts = [BAG]
    for k in range(K):
        parts.append(f"m{k} AS MATERIALIZED (SELECT p, n FROM ({_pairs(f's{k}')}) ORDER BY n DESC, p LIMIT 1)")
        parts.append(f"s{k + 1} AS MATERIALIZED (SELECT word, freq, replace(s, (SELECT p FROM m{k}), chr({65536 + 256 + k})) AS s FROM s{k})")
    return ",\n".join(parts)


TRAIN = _training()
MERGES = " UNION ALL ".join(f"SELECT {k} AS k, p, n FROM m{k}" for k in range(K))
IDS = "array_to_string(list_transform(regexp_extract_all({0}, '(?s).'), lambda c: (unicode(c) - 65536)::VARCHAR), ',')"


def _vocab() -> str:
    """After TRAIN: v(token_id, h) with the hexadecimal bytes of each token."""
    parts = ["v0 AS (SELECT range::INT AS token_id, printf('%02X', range::INT) AS h FROM range(256))"]
    for k in range(K):
        side = lambda i, k=k: f"(SELECT h FROM v{k} WHERE token_id = (SELECT unicode(substr(p, {i}, 1)) - 65536 FROM m{k}))"
        parts.append(f"v{k + 1} AS MATERIALIZED (SELECT * FROM v{k} UNION ALL SELECT {256 + k}, {side(1)} || {side(2)})")
    return ",\n".join(parts) + f",\nv AS (SELECT token_id, h FROM v{K})"


VOCAB = _vocab()
NODES = """
t AS (SELECT h, max(token_id) AS token_id FROM v WHERE h <> '' GROUP BY h),
p AS (SELECT DISTINCT substr(h, 1, 2 * k) AS prefix FROM (SELECT h, unnest(range(0, length(h) // 2 + 1)) AS k FROM t)),
c AS (SELECT substr(prefix, 1, length(prefix) - 2) AS prefix, count(*) AS n FROM p WHERE prefix <> '' GROUP BY 1),
nodes AS (
  SELECT (row_number() OVER o - 1)::INT AS node_id, p.prefix,
         (1 + coalesce(sum(coalesce(c.n, 0)) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::INT AS first_child,
         coalesce(c.n, 0)::INT AS num_children, coalesce(t.token_id, 4294967295)::BIGINT AS token_id
  FROM p LEFT JOIN c USING (prefix) LEFT JOIN t ON t.h = p.prefix WINDOW o AS (ORDER BY length(p.prefix), p.prefix)
)"""


def _encoded(source: str, column: str = "text") -> str:
    s = SYMBOLS_OF.format(column)
    for k in range(K):
        s = f"replace({s}, (SELECT p FROM m{k}), chr({65536 + 256 + k}))"
    return f"SELECT *, {s} AS s FROM {source}"


#: Alternation of the merged tokens as symbols, longest first, then any byte.
ALTERNATION = """
alternatives AS (
  SELECT string_agg(a, '|' ORDER BY length(a) DESC, a) || '|(?s:.)' AS re
  FROM (SELECT array_to_string(list_transform(range(0, length(h) // 2), lambda i: chr((65536 + ('0x' || substr(h, 2 * i + 1, 2))::INT)::INT)), '') AS a FROM v WHERE token_id >= 256)
), lookup AS (
  SELECT array_to_string(list_transform(range(0, length(h) // 2), lambda i: chr((65536 + ('0x' || substr(h, 2 * i + 1, 2))::INT)::INT)), '') AS a, max(token_id) AS token_id FROM v GROUP BY 1
), longest AS (SELECT greatest(512, least(2048, 8 * max(length(h) // 2)))::BIGINT AS size FROM v),
chunked AS (
  SELECT doc_id, k AS chunk, substr(s, k * size + 1, size) AS part, size
  FROM (SELECT doc_id, s, size, unnest(range(0, (length(s) + size - 1) // size)) AS k FROM (SELECT doc_id, {symbols} AS s FROM documents), longest)
), matched AS (SELECT doc_id, chunk, regexp_extract_all(part, (SELECT re FROM alternatives)) AS m FROM chunked)
""".replace("{symbols}", SYMBOLS_OF.format("text"))

DISPLAY = "CASE WHEN b = 32 THEN '▁' WHEN b = 10 THEN '\\n' WHEN b BETWEEN 33 AND 126 THEN chr(b) ELSE printf('<0x%02X>', b) END"

def _many_merges() -> str:
    s = SYMBOLS_OF.format("text")
    for k, (a, b) in enumerate(LETTER_PAIRS):
        s = f"replace({s}, chr({65536 + a}) || chr({65536 + b}), chr({65536 + 256 + k}))"
    return s


#: Display of the bytes h: valid UTF-8 as it is, other bytes by DISPLAY.
DISPLAYED = f"""array_to_string(list_transform(regexp_extract_all(h, '(?:C[2-9A-F]|D[0-9A-F])[89AB][0-9A-F]|E[0-9A-F](?:[89AB][0-9A-F]){{2}}|F[0-4](?:[89AB][0-9A-F]){{3}}|..'),
  lambda x: CASE WHEN length(x) > 2 THEN decode(unhex(x)) ELSE {DISPLAY.replace("b ", "(('0x' || x)::INT) ").replace("chr(b)", "chr(('0x' || x)::INT)").replace("', b)", "', ('0x' || x)::INT)")} END), '')"""
#: A number's four bytes, lowest first, in hexadecimal.
LITTLE = "printf('%02X%02X%02X%02X', ({0}) % 256, ({0}) // 256 % 256, ({0}) // 65536 % 256, ({0}) // 16777216)"
SCRIPT_CASE = "CASE WHEN regexp_matches(c, '\\p{Latin}') THEN 3 WHEN regexp_matches(c, '\\p{Common}') THEN 1 WHEN regexp_matches(c, '\\p{Inherited}') THEN 2 ELSE 0 END"
CATEGORY_CASE = "CASE " + " ".join(
    f"WHEN regexp_matches(c, '\\p{{{c}}}') THEN {k}" for k, c in enumerate("Lu Ll Lt Lm Lo Mn Mc Me Nd Nl No Pc Pd Ps Pe Pi Pf Po Sm Sc Sk So Zs Zl Zp Cc Cf".split(), 1)
) + " ELSE 0 END"
#: Every character and every byte of the texts with its number.
TEXTS = "texts AS (SELECT text FROM documents UNION ALL SELECT text FROM conversations UNION ALL SELECT html FROM pages UNION ALL SELECT text FROM benchmark)"
CHARACTERS = f"{TEXTS}, ch AS (SELECT c, unicode(c) AS cp, count(*) AS n FROM (SELECT unnest(regexp_extract_all(text, '(?s).')) AS c FROM texts) GROUP BY c)"
BYTES = f"{TEXTS}, bytes_ AS (SELECT ('0x' || h)::INT AS byte, count(*) AS n FROM (SELECT unnest(regexp_extract_all(hex(encode(text)), '..')) AS h FROM texts) GROUP BY h)"
#: Hexadecimal bytes of valid UTF-8.
VALID = "(?:[0-7].|(?:C[2-9A-F]|D.)[89AB].|E0[AB].[89AB].|(?:E[1-9A-CEF])(?:[89AB].){2}|ED[89].[89AB].|F0[9AB].(?:[89AB].){2}|F[1-3](?:[89AB].){3}|F48.(?:[89AB].){2})*"
BLANKS = "replace(text, '.' || chr(10), '.' || repeat(chr(10), 2) || ' ' || repeat(chr(10), 3))"
PARAGRAPHS = f"""SELECT doc_id, unnest(range(0, len(l)))::BIGINT AS par_idx, unnest(l) AS par FROM (
  SELECT doc_id, list_filter(regexp_split_to_array({BLANKS}, '\\n\\n+'), lambda x: regexp_matches(x, '[^\\s\\x{{A0}}]')) AS l FROM documents)"""

#: The documents as one sequence in hexadecimal, and, after TRAIN, VOCAB and ALTERNATION, the matches of each of its chunks.
JOINED = "joined AS MATERIALIZED (SELECT string_agg(hex(encode(text)), '0A0A' ORDER BY doc_id) AS h FROM documents)"
CORPUS_CHUNKS = f"""{JOINED}, byte_ AS (
  SELECT unnest(range(0, len(l))) AS i, ('0x' || unnest(l))::INT AS b FROM (SELECT regexp_extract_all(h, '..') AS l FROM joined)
), m AS MATERIALIZED (
  SELECT chunk, regexp_extract_all(part, (SELECT re FROM alternatives)) AS m FROM (
    SELECT i // (SELECT size FROM longest) AS chunk, string_agg(chr(65536 + b), '' ORDER BY i) AS part FROM byte_ GROUP BY 1)
), corpus_chunk AS MATERIALIZED (
  SELECT chunk, m, len(m) AS tokens, coalesce(sum(len(m)) OVER (ORDER BY chunk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS offset FROM m
)"""


def _sequence_merges(k: int) -> str:
    """Tables q0..qk of the sequence's symbols by place, b0..b(k-1) of best pairs."""
    parts = [f"{JOINED}, q0 AS MATERIALIZED (SELECT unnest(range(0, len(l))) AS i, ('0x' || unnest(l))::INT AS s FROM (SELECT regexp_extract_all(h, '..') AS l FROM joined))"]
    for j in range(k):
        parts.append(f"""n{j} AS MATERIALIZED (SELECT i, s, lead(s) OVER o AS nxt, lead(i) OVER o AS ni FROM q{j} WINDOW o AS (ORDER BY i)),
b{j} AS MATERIALIZED (SELECT s AS a, nxt AS b, count(*) AS n FROM n{j} WHERE s > 0 AND nxt > 0 GROUP BY ALL ORDER BY n DESC, a, b LIMIT 1),
h{j} AS (SELECT i, ni, coalesce(lag(ni) OVER (ORDER BY i) <> i, true) AS begins FROM n{j}, b{j} WHERE s = a AND nxt = b),
r{j} AS (SELECT i, ni, sum(begins::INT) OVER (ORDER BY i ROWS UNBOUNDED PRECEDING) AS run FROM h{j}),
t{j} AS MATERIALIZED (SELECT i, ni FROM (SELECT i, ni, row_number() OVER (PARTITION BY run ORDER BY i) AS k FROM r{j}) WHERE k % 2 = 1),
q{j + 1} AS MATERIALIZED (SELECT n{j}.i, CASE WHEN t.i IS NULL THEN s ELSE {256 + j} END AS s FROM n{j} LEFT JOIN t{j} t ON t.i = n{j}.i WHERE n{j}.i NOT IN (SELECT ni FROM t{j}))""")
    return ",\n".join(parts)


ORACLES: dict[str, str] = {
    "train_sequence_4": f"WITH {_sequence_merges(4)} "
    + " UNION ALL ".join(f"SELECT {j} AS merge_idx, a::INT AS a, b::INT AS b, {256 + j} AS new_id, n AS count FROM b{j}" for j in range(4)),
    "corpus_chunks": f"WITH {TRAIN},\n{VOCAB},\n{ALTERNATION},\n{CORPUS_CHUNKS} SELECT chunk, tokens, \"offset\" FROM corpus_chunk",
    "corpus_export": f"""
        WITH {TRAIN},\n{VOCAB},\n{ALTERNATION},\n{CORPUS_CHUNKS},
        ids AS (SELECT "offset" + i AS place, token_id FROM (SELECT "offset", unnest(m) AS a, unnest(range(0, len(m))) AS i FROM corpus_chunk) JOIN lookup USING (a))
        SELECT place // 10000 AS block, count(*) AS n_tokens, sum(token_id * (place % 10000 + 1))::BIGINT AS ids_sum, (SELECT count(*) FROM ids) AS total FROM ids GROUP BY 1""",
    "corpus_profile": """
        SELECT count(*) AS n_docs, sum(strlen(text))::BIGINT AS total_bytes, sum(length(text))::BIGINT AS total_chars,
               CASE WHEN sum(strlen(text)) < 1024 THEN sum(strlen(text)) || ' B' WHEN sum(strlen(text)) < 1048576 THEN printf('%.1f KB', sum(strlen(text)) / 1024.0)
                    ELSE printf('%.1f MB', sum(strlen(text)) / 1048576.0) END AS size_text FROM documents""",
    "ext_filter": f"""
        WITH n AS (SELECT page_id, url || (['/a.TXT', '/a.b.md', '/noext', '/x.png', '/y.html', '/z.tar.gz', '/w.'])[page_id % 7 + 1] AS name FROM pages)
        SELECT page_id, name, lower(regexp_extract(name, '\\.([^.]*)$', 1)) AS ext FROM n WHERE lower(regexp_extract(name, '\\.([^.]*)$', 1)) IN ({", ".join(f"'{x}'" for x in TEXT_EXTENSIONS)})""",
    "paragraph_split": f"SELECT doc_id, par_idx, md5(par) AS par_md5 FROM ({PARAGRAPHS})",
    "paragraph_shuffle": f"SELECT doc_id, par_idx, md5('42:' || doc_id || ':' || par_idx) AS shuffle_key FROM ({PARAGRAPHS})",
    "corpus_concat": """
        WITH j AS (SELECT conv_id, string_agg(text, chr(10) || chr(10) ORDER BY turn) AS text FROM conversations GROUP BY conv_id)
        SELECT conv_id, md5(text) AS text_md5, strlen(text) AS n_bytes FROM j""",
    "nfc_normalize": """
        WITH n AS (SELECT doc_id, nfc_normalize(replace(replace(text, 'e', 'e' || chr(769)), 'a', 'a' || chr(776))) AS n FROM documents)
        SELECT doc_id, md5(n) AS text_md5, length(n) AS n_chars FROM n""",
    "codepoint_class_counts": " UNION ALL ".join(
        f"SELECT {k} AS class, '{n}' AS name, sum(len(regexp_extract_all(text, '{CLASS_RE[n]}')))::BIGINT AS n FROM documents"
        for k, n in enumerate(("LETTER", "DIGIT", "WHITESPACE", "PUNCTUATION", "SYMBOL", "NEWLINE", "OTHER"))
    ),
    "unicode_words": f"""
        WITH ch AS (SELECT doc_id, unnest(range(1, len(l) + 1)) AS i, unnest(l) AS c FROM (SELECT doc_id, regexp_extract_all(text, '(?s).') AS l FROM documents)),
        cl AS (SELECT *, {_class_case("c")} AS k FROM ch),
        near AS (
          SELECT *, lag(k) OVER w AS p, lead(c, 1) OVER w AS c1, lead(c, 2) OVER w AS c2, lead(k, 1) OVER w AS k1, lead(k, 2) OVER w AS k2, lead(k, 3) OVER w AS k3
          FROM cl WINDOW w AS (PARTITION BY doc_id ORDER BY i)
        ), con AS (
          SELECT *, coalesce(p = 0 AND c IN ('''', '’') AND (
              (lower(c1) IN ('s', 't', 'm', 'd') AND ascii(c1) < 128 AND coalesce(k2, 6) <> 0)
              OR (lower(c1 || c2) IN ('re', 've', 'll') AND coalesce(k3, 6) <> 0)), false) AS contraction
          FROM near
        ), runs AS (
          SELECT *, lag(contraction, 1, false) OVER w AS after_con, sum(CASE WHEN k = 1 AND coalesce(p, -1) <> 1 THEN 1 ELSE 0 END) OVER w AS run
          FROM con WINDOW w AS (PARTITION BY doc_id ORDER BY i)
        ), dig AS (SELECT *, CASE WHEN k = 1 THEN row_number() OVER (PARTITION BY doc_id, run, k ORDER BY i) - 1 END AS place FROM runs),
        cut AS (
          SELECT doc_id, i, c, CASE
            WHEN p IS NULL THEN true WHEN k = 5 OR p = 5 THEN true WHEN k = 2 THEN p <> 2 WHEN p = 2 THEN false
            WHEN contraction OR after_con THEN false
            WHEN k = 1 AND p = 1 THEN place % 3 = 0
            WHEN k = 6 OR p = 6 THEN false
            WHEN (k = 0) <> (p = 0) OR (k = 1) <> (p = 1) THEN true ELSE false END AS starts
          FROM dig
        ), marks AS (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS nxt FROM cut WHERE starts),
        n AS (SELECT doc_id, length(text) AS n FROM documents)
        SELECT doc_id, count(i) AS n_words, md5(coalesce(string_agg((coalesce(nxt, n + 1) - i)::VARCHAR, ',' ORDER BY i), '')) AS lengths_md5
        FROM n LEFT JOIN marks USING (doc_id) GROUP BY doc_id""",
    "paragraph_permutation": f"""
        WITH p AS (SELECT *, row_number() OVER (ORDER BY doc_id, par_idx) - 1 AS number FROM ({PARAGRAPHS})), r0 AS (SELECT *, number AS x, count(*) OVER () AS n FROM p), {_swap_rounds()}
        SELECT doc_id, par_idx, strlen(par) AS n_bytes, number, x AS place, number AS back FROM r{ROUNDS}""",
    "file_scan": """
        WITH t AS (
          SELECT 'documents-' || doc_id AS file, doc_id AS k, text FROM documents UNION ALL SELECT 'pages-' || page_id, page_id, html FROM pages
        ), d AS (SELECT file, k % 7 = 0 AS stray, nfc_normalize(CASE WHEN k % 7 = 0 THEN chr(65533) ELSE '' END || replace(text, 'e', 'e' || chr(769)) || chr(10)) AS text FROM t)
        SELECT file, CASE WHEN stray THEN 'replaced' ELSE 'text' END AS status, strlen(text) AS n_bytes, md5(text) AS text_md5 FROM d""",
    "byte_words": f"""
        WITH w AS (SELECT doc_id, regexp_extract_all(text, '{BYTE_WORDS}') AS w FROM documents)
        SELECT doc_id, len(w) AS n_words, md5(array_to_string(list_transform(w, lambda x: length(x)::VARCHAR), ',')) AS lengths_md5 FROM w""",
    "word_bag_top": f"WITH {BAG} SELECT word, freq FROM bag ORDER BY freq DESC, word LIMIT 100",
    "pair_counts": f"WITH {BAG} SELECT (unicode(p) - 65536)::INT AS a, (unicode(substr(p, 2)) - 65536)::INT AS b, n AS count FROM ({_pairs('s0')})",
    "top_byte_pairs": f"WITH {BAG} SELECT (unicode(p) - 65536)::INT AS a, (unicode(substr(p, 2)) - 65536)::INT AS b, n AS count FROM ({_pairs('s0')}) ORDER BY n DESC, p LIMIT 20",
    "best_pair": f"WITH {BAG} SELECT (unicode(p) - 65536)::INT AS a, (unicode(substr(p, 2)) - 65536)::INT AS b, n AS count FROM ({_pairs('s0')}) ORDER BY n DESC, p LIMIT 1",
    "merge_step": f"""
        WITH {BAG}, m AS MATERIALIZED (SELECT p FROM ({_pairs("s0")}) ORDER BY n DESC, p LIMIT 1),
        x AS (SELECT word, freq, length(s) AS n_before, length(replace(s, (SELECT p FROM m), 'x')) AS n_after FROM s0)
        SELECT * FROM x WHERE n_before > n_after""",
    "train_merges_8": f"""
        WITH {TRAIN} SELECT k AS merge_idx, (unicode(p) - 65536)::INT AS a, (unicode(substr(p, 2)) - 65536)::INT AS b, (256 + k)::INT AS new_id, n AS count FROM ({MERGES}) WHERE n >= 2""",
    "train_progress": f"WITH {TRAIN} "
    + " UNION ALL ".join(
        f"SELECT {k + 1} AS merge_index, {K} AS total_merges, (SELECT n FROM m{k}) AS best_count, sum(freq * length(s))::BIGINT AS symbol_count FROM s{k + 1}" for k in range(K)
    ),
    "vocab_table": f"WITH {TRAIN},\n{VOCAB} SELECT token_id, h AS bytes_hex FROM v",
    "model_json_roundtrip": f"WITH {TRAIN},\n{VOCAB} SELECT token_id, h AS bytes_hex FROM v",
    "display_bytes": f"WITH {BYTES} SELECT b AS byte, n, {DISPLAY} AS display FROM (SELECT byte AS b, n FROM bytes_)",
    "encode_merge_order": f"WITH {TRAIN} SELECT doc_id, length(s) AS n_tokens, md5({IDS.format('s')}) AS tokens_md5 FROM ({_encoded('documents')})",
    "encode_many_merges": f"SELECT doc_id, length(s) AS n_tokens, md5({IDS.format('s')}) AS tokens_md5 FROM (SELECT doc_id, {_many_merges()} AS s FROM documents)",
    "display_strings": f"WITH {TRAIN},\n{VOCAB} SELECT token_id, {DISPLAYED} AS display FROM v",
    "token_spans": f"""
        WITH {TRAIN},\n{VOCAB}, b AS (SELECT item_id, trim(text) AS text FROM benchmark WHERE trim(text) <> ''), e AS ({_encoded("b")}),
        t AS (SELECT item_id, unnest(range(0, length(s)))::BIGINT AS pos, unicode(unnest(regexp_extract_all(s, '(?s).'))) - 65536 AS token_id FROM e),
        d AS (SELECT token_id, replace(replace(replace(replace({DISPLAYED}, chr(10), '\\n'), chr(9), '\\t'), chr(13), '\\r'), ' ', '·') AS x FROM v)
        SELECT item_id, pos, '<span class="token" title="Token ID: ' || token_id || '">' || x || '<span class="token-id">#' || token_id || '</span></span>' AS span FROM t JOIN d USING (token_id)""",
    "bin_export": f"""
        WITH {TRAIN}, e AS ({_encoded("benchmark")})
        SELECT item_id, md5(unhex({LITTLE.format(0x44584654)} || {LITTLE.format(256 + K)} || {LITTLE.format("length(s)")} || {LITTLE.format(2)} ||
          coalesce(array_to_string(list_transform(regexp_extract_all(s, '(?s).'), lambda c: {LITTLE.format("unicode(c) - 65536")}), ''), '') || '7B7D')) AS export_md5 FROM e""",
    "bin_export_longest": f"""
        WITH {TRAIN},\n{VOCAB},\n{ALTERNATION.replace("documents", "benchmark").replace("doc_id", "item_id")},
        ids AS (SELECT item_id, chunk, unnest(m) AS a, unnest(range(0, len(m))) AS i FROM matched),
        t AS (SELECT item_id, count(*) AS n, string_agg({LITTLE.format("token_id")}, '' ORDER BY chunk, i) AS body FROM ids JOIN lookup USING (a) GROUP BY item_id)
        SELECT item_id, md5(unhex({LITTLE.format(0x44584654)} || {LITTLE.format(256 + K)} || {LITTLE.format("n")} || {LITTLE.format(2)} || body || '7B7D')) AS export_md5 FROM t""",
    "trie_binary_roundtrip": f"""
        WITH {TRAIN},\n{VOCAB},\n{NODES}
        SELECT 3 AS version, count(*)::INT AS n_nodes, (count(*) - 1)::INT AS n_edges, (max(length(prefix)) // 2)::INT AS longest, (SELECT count(*) FROM v)::INT AS vocab_size FROM nodes""",
    "case_mapping": "SELECT doc_id, md5(upper(replace(text, 'ß', 'SS'))) AS upper_md5, md5(lower(text)) AS lower_md5 FROM documents",
    "unicode_categories": f"WITH {CHARACTERS} SELECT cp, n, ({CATEGORY_CASE})::INT AS category, ({SCRIPT_CASE})::INT AS script FROM ch",
    "unicode_scripts": f"""
        WITH {CHARACTERS} SELECT CASE {" ".join(f"WHEN regexp_matches(c, '{chr(92)}p{{{x.title()}}}') THEN '{x}'" for x in ("COMMON", "INHERITED", "LATIN", "GREEK", "CYRILLIC", "ARABIC", "HEBREW", "HAN", "HIRAGANA", "KATAKANA", "HANGUL"))} ELSE 'UNKNOWN' END AS script,
               sum(n)::BIGINT AS n FROM ch GROUP BY 1""",
    "normal_forms": """
        WITH r AS (SELECT doc_id, replace(text, 'e', 'e' || chr(769)) AS t FROM documents), d AS (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN replace(t, 'a', chr(1072)) ELSE t END AS t FROM r)
        SELECT doc_id, nfc_normalize(t) = t AS is_nfc, NOT regexp_matches(t, '[\\x{C0}-\\x{C5}\\x{C7}-\\x{CF}\\x{D1}-\\x{D6}\\x{D9}-\\x{DD}\\x{E0}-\\x{E5}\\x{E7}-\\x{EF}\\x{F1}-\\x{F6}\\x{F9}-\\x{FD}\\x{FF}]') AS is_nfd,
               md5(nfc_normalize(t)) AS nfc_md5, doc_id % 6 <> 0 OR strlen(t) % 2 = 0 AS well_formed,
               regexp_matches(t, '\\p{Latin}') AND regexp_matches(t, '\\p{Cyrillic}') AS suspicious FROM d""",
    "stream_encode": f"WITH {TRAIN} SELECT doc_id, length(s) AS n_tokens, md5({IDS.format('s')}) AS tokens_md5 FROM ({_encoded('documents')})",
    "trie_nodes": f"WITH {TRAIN},\n{VOCAB},\n{NODES} SELECT node_id, prefix, first_child, num_children, token_id FROM nodes",
    "trie_edges": f"""
        WITH {TRAIN},\n{VOCAB},\n{NODES}
        SELECT node_id - 1 AS edge_id, ('0x' || right(prefix, 2))::INT AS symbol, node_id AS target FROM nodes WHERE node_id > 0""",
    "encode_longest_match_parts": "",
    "encode_longest_match": f"""
        WITH {TRAIN},\n{VOCAB},\n{ALTERNATION},
        ids AS (SELECT doc_id, chunk, unnest(m) AS a, unnest(range(0, len(m))) AS i FROM matched)
        SELECT doc_id, count(*) AS n_tokens, md5(string_agg(token_id::VARCHAR, ',' ORDER BY chunk, i)) AS tokens_md5 FROM ids JOIN lookup USING (a) GROUP BY doc_id""",
    "chunk_offsets": f"""
        WITH {TRAIN},\n{VOCAB},\n{ALTERNATION}
        SELECT doc_id, chunk, len(m) AS tokens, coalesce(sum(len(m)) OVER (PARTITION BY doc_id ORDER BY chunk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS offset FROM matched""",
    "decode_roundtrip": "SELECT doc_id, md5(text) AS bytes_md5 FROM documents",
    "decode_unknown": f"""
        WITH {TRAIN},\n{VOCAB}, e AS ({_encoded("documents")}), known AS MATERIALIZED (SELECT * FROM v WHERE token_id < {256 + K // 2}),
        t AS (SELECT doc_id, unnest(range(0, length(s))) AS i, unicode(unnest(regexp_extract_all(s, '(?s).'))) - 65536 AS token_id FROM e),
        b AS (SELECT doc_id, string_agg(coalesce(h, 'EFBFBD'), '' ORDER BY i) AS b FROM t LEFT JOIN known USING (token_id) GROUP BY doc_id)
        SELECT doc_id, md5(unhex(b)) AS bytes_md5, length(b) // 2 AS n_bytes FROM b""",
    "compression_by_lang": f"""
        WITH {TRAIN}, e AS (SELECT lang, sum(strlen(text))::BIGINT AS n_bytes, sum(length(s))::BIGINT AS n_tokens FROM ({_encoded("documents")}) GROUP BY lang)
        SELECT lang, n_bytes, n_tokens, round(n_bytes / n_tokens, 2) AS ratio FROM e""",
    "format_size": """
        WITH d AS (SELECT doc_id, n_chars * doc_id AS n FROM documents)
        SELECT doc_id, CASE WHEN n < 1024 THEN n || ' B' WHEN n < 1048576 THEN printf('%.1f KB', floor(n / 102.4 + 0.5) / 10) ELSE printf('%.1f MB', floor(n / 104857.6 + 0.5) / 10) END AS size_text FROM d""",
    "format_duration": """
        WITH r AS (SELECT o_orderkey AS id, o_orderkey * 7.25::DOUBLE AS x FROM orders), m AS (SELECT *, floor(x / 60)::BIGINT AS m, round(x - 60 * floor(x / 60))::BIGINT AS s FROM r)
        SELECT id, CASE WHEN x < 60 THEN printf('%.1fs', floor(x * 10 + 0.5) / 10) WHEN s > 0 THEN m || 'm ' || s || 's' ELSE m || 'm' END AS trained,
               CASE WHEN x < 60 THEN round(x)::BIGINT || 's' WHEN m < 60 AND s > 0 THEN m || 'm ' || s || 's' WHEN m < 60 THEN m || 'm'
                    WHEN m % 60 > 0 THEN (m // 60) || 'h ' || (m % 60) || 'm' ELSE (m // 60) || 'h' END AS left_text FROM m""",
    "vocab_text_export": f"""
        WITH {TRAIN},\n{VOCAB}, b AS (SELECT token_id, {DISPLAYED} AS d, array_to_string(list_transform(regexp_extract_all(h, '..'), lambda x: ('0x' || x)::INT), ',') AS b FROM v),
        l AS (SELECT '# Vocabulary' || chr(10) || '# Total tokens: ' || count(*) || chr(10) || chr(10) || string_agg(token_id || chr(9) || d || chr(9) || '[' || b || ']', chr(10) ORDER BY token_id) || chr(10) AS t FROM b)
        SELECT md5(t) AS text_md5, length(t) AS n_chars FROM l""",
    "character_classes": f"WITH {CHARACTERS} SELECT cp, n, ({_class_case('c')})::INT AS class FROM ch",
    "byte_classes": f"""
        WITH {BYTES} SELECT byte, n, (CASE WHEN byte = 32 THEN 2 WHEN byte = 10 THEN 4 WHEN byte >= 128 THEN 0
               WHEN regexp_matches(chr(byte), '[A-Za-z]') THEN 0 WHEN regexp_matches(chr(byte), '[0-9]') THEN 1 ELSE 3 END)::INT AS class FROM bytes_""",
    "unicode_properties": f"WITH {CHARACTERS} SELECT cp, n, "
    + ", ".join(
        f"regexp_matches(c, '\\p{{{c}}}') AS {n}"
        for n, c in (
            ("letter", "L"), ("uppercase", "Lu"), ("lowercase", "Ll"), ("titlecase", "Lt"), ("digit", "Nd"), ("number", "N"), ("punctuation", "P"),
            ("symbol", "S"), ("mark", "M"), ("separator", "Z"), ("control", "Cc"), ("format", "Cf"), ("space", "Zs"),
        )
    )
    + " FROM ch",
    "grapheme_count": """
        WITH d AS (SELECT doc_id, replace(text, 'e', 'e' || chr(769)) AS t FROM documents) SELECT doc_id, length_grapheme(t) AS n_graphemes, length(t) AS n_chars FROM d""",
    "utf8_valid": f"""
        WITH h AS (SELECT doc_id, text, hex(encode(text)) AS h FROM documents), b AS (SELECT doc_id, text, CASE WHEN doc_id % 3 = 0 THEN substr(h, 1, length(h) - 2) WHEN doc_id % 7 = 0 THEN 'C3' || h ELSE h END AS h FROM h)
        SELECT doc_id, regexp_full_match(h, '{VALID}') AS valid, length(h) // 2 AS n_bytes, md5(array_to_string(list_transform(regexp_extract_all(text, '(?s).'), lambda c: unicode(c)::VARCHAR), ',')) AS codepoints_md5 FROM b""",
}
ORACLES["encode_longest_match_parts"] = ORACLES["encode_longest_match"]
_JOINED = "WITH joined AS (SELECT doc_id // 100 AS doc_id, string_agg(text, chr(10) || chr(10) ORDER BY doc_id) AS text FROM documents GROUP BY 1), ch AS"
_WORDS = ORACLES["unicode_words"].replace("FROM documents", "FROM joined").replace("WITH ch AS", _JOINED)
ORACLES["giant_text_words"] = f"SELECT doc_id AS block, n_words, lengths_md5 FROM ({_WORDS})"
