"""One registered query per operator, over its whole table, with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from ..session import scratch_path
from . import conversation_trie, fm_index, inverted_index, line_templates, minhash, mixing, spelling, suffixes, token_counts, token_files, toxicity, vptree, warc
from .registry import ORACLES, QUERIES, query, table

__all__ = ["ORACLES", "QUERIES"]

@query("op2_warc")
def _(spark, d):
    return warc.archive(table(spark, d, "pages"), scratch_path(spark, "warc")).drop("url", "file")


# The contract's words: A-Z in lower case, anything but the six white-space bytes
_LOW = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_SHINGLES = f"""w AS (SELECT doc_id, regexp_extract_all({_LOW}, '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
  s AS (SELECT doc_id, CASE WHEN coalesce(len(w), 0) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
      ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s FROM w)"""


@query(
    "op3_near_duplicates",
    f"""WITH RECURSIVE {_SHINGLES},
      e AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM s),
      p AS (SELECT a.doc_id AS a, b.doc_id AS b FROM e a JOIN e b ON a.g = b.g AND a.doc_id <> b.doc_id
            GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
      r AS (SELECT doc_id, doc_id AS c FROM documents UNION SELECT p.b, r.c FROM r JOIN p ON p.a = r.doc_id),
      m AS (SELECT doc_id, min(c) AS component_id FROM r GROUP BY doc_id)
    SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, component_id, doc_id = component_id AS kept FROM s JOIN m USING (doc_id)""",
)
def _(spark, d):
    return minhash.near_duplicates(table(spark, d, "documents"), percent=85)


_WORDS = f"regexp_extract_all({_LOW}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"


@query(
    "op7_decontamination",
    f"""WITH i AS (SELECT item_id, {_WORDS} AS w FROM benchmark WHERE text IS NOT NULL),
      v AS (SELECT item_id, unnest(list_transform(range(1, greatest(len(w) - 9, 1) + 1), lambda i: w[i:i + 9])) AS w FROM i WHERE len(w) > 0),
      win AS (SELECT DISTINCT item_id, len(w) AS n, array_to_string(w, ' ') AS s FROM v),
      d AS (SELECT doc_id, coalesce({_WORDS}, []) AS w FROM documents),
      g AS (SELECT doc_id, n, unnest(range(1, len(w) - n + 2)) AS p, w FROM d, (SELECT DISTINCT n FROM win)),
      h AS (SELECT g.doc_id, g.p, g.n, win.item_id FROM g JOIN win ON win.n = g.n AND win.s = array_to_string(g.w[g.p:g.p + g.n - 1], ' ')),
      c AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS q FROM h) GROUP BY doc_id),
      t AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, array_to_string(list_sort(list_distinct(list(CAST(item_id AS VARCHAR)))), ',') AS ids FROM h GROUP BY doc_id)
    SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
      sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated FROM d LEFT JOIN c USING (doc_id) LEFT JOIN t USING (doc_id)""",
)
def _(spark, d):
    return inverted_index.contamination(table(spark, d, "documents"), table(spark, d, "benchmark")).drop("text_hash")


def _slot_sql(turn: int) -> str:
    step = "CASE " + " ".join(f"WHEN n % {p} <> 0 THEN {p}" for p in mixing.PRIMES[:-1]) + f" ELSE {mixing.PRIMES[-1]} END"
    return f"(block * (({step}) % n) + {(turn + 1) * 7919}) % n + {turn} * n"


@query(
    "op5_mixing",
    f"""WITH d AS (SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS size FROM documents),
      s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS g FROM d GROUP BY source),
      r AS (SELECT *, [3, 1, 2][(g - 1) % 3 + 1] AS w, source_size * 2 AS stop, source_size * 2 / [3, 1, 2][(g - 1) % 3 + 1] AS ratio FROM s),
      l AS (SELECT *, (1.5 * CAST(sum(source_size) OVER () AS DOUBLE) - CAST(sum(stop) OVER o AS DOUBLE) + stop) / CAST(sum(w) OVER () - sum(w) OVER o + w AS DOUBLE) AS level
            FROM r WINDOW o AS (ORDER BY ratio, g ROWS UNBOUNDED PRECEDING)),
      t AS (SELECT source, g, source_size, least(CAST(stop AS DOUBLE), (SELECT level FROM l WHERE level <= ratio ORDER BY ratio, g LIMIT 1) * w) AS target FROM l),
      b AS (SELECT *, greatest(1, least(256, source_size // 64)) AS b FROM t),
      n AS (SELECT *, CAST(ceil(source_size / b) AS BIGINT) AS n FROM b),
      k AS (SELECT *, least(2 * n, CAST(floor(target / b + 0.5) AS BIGINT)) AS k FROM n),
      p AS (SELECT d.doc_id, d.size, k.* EXCLUDE (source), sum(d.size) OVER (PARTITION BY g ORDER BY md5('1|' || d.doc_id), d.doc_id ROWS UNBOUNDED PRECEDING) - d.size AS start
            FROM d JOIN k ON d.source IS NOT DISTINCT FROM k.source),
      e AS (SELECT *, unnest(range(CAST(start // b AS BIGINT), CAST((start + size - 1) // b + 1 AS BIGINT))) AS block FROM p WHERE size > 0),
      x AS (SELECT doc_id, (least(start + size, (block + 1) * b) - greatest(start, block * b)) * (CAST({_slot_sql(0)} < k AS INT) + CAST({_slot_sql(1)} < k AS INT)) AS words FROM e),
      y AS (SELECT doc_id, sum(words) AS taken FROM x GROUP BY doc_id)
    SELECT doc_id, size, source_size, target, CAST(coalesce(taken, 0) AS BIGINT) AS taken FROM p LEFT JOIN y USING (doc_id)""",
)
def _(spark, d):
    return mixing.mix_report(table(spark, d, "documents"))


@query("op6_token_counts")
def _(spark, d):
    path = public_tokenizers.path("piece_bpe_32k.model")
    return token_counts.token_counts(table(spark, d, "documents"), path, scratch_path(spark, "token-counts"))


@query("op8_token_files")
def _(spark, d):
    path = public_tokenizers.path("word_bpe_49k.json")
    return token_files.token_files(table(spark, d, "documents"), path, scratch_path(spark, "token-ids")).drop("file")


@query("op10_toxicity")
def _(spark, d):
    return toxicity.toxicity(table(spark, d, "documents"), table(spark, d, "labels")).drop("text_hash")


@query(
    "op9_repeated_substrings",
    """WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS b FROM documents),
      x AS (SELECT doc_id, hex(b) AS h, octet_length(b) AS n FROM d),
      w AS (SELECT doc_id, unnest(range(1, n - 48)) AS p, h FROM x WHERE n >= 50),
      s AS (SELECT doc_id, p, md5_number(substr(h, 2 * p - 1, 100)) AS s FROM w),
      f AS (SELECT s, min(doc_id) AS first FROM s GROUP BY s),
      g AS (SELECT doc_id, p FROM s JOIN f USING (s) WHERE doc_id > first),
      i AS (SELECT doc_id, p, p > coalesce(lag(p) OVER o + 50, 0) AS new FROM g WINDOW o AS (PARTITION BY doc_id ORDER BY p)),
      j AS (SELECT doc_id, p, sum(CAST(new AS INT)) OVER (PARTITION BY doc_id ORDER BY p) AS k FROM i),
      r AS (SELECT doc_id, k, min(p) AS a, max(p) + 50 AS z FROM j GROUP BY doc_id, k),
      c AS (SELECT doc_id, sum(z - a) AS n_removed, count(*) AS n_spans FROM r GROUP BY doc_id),
      e AS (SELECT doc_id, a, lag(z, 1, 1) OVER (PARTITION BY doc_id ORDER BY a) AS was FROM r UNION ALL SELECT doc_id, n + 1, coalesce((SELECT max(z) FROM r WHERE r.doc_id = x.doc_id), 1) FROM x),
      k AS (SELECT e.doc_id, string_agg(substr(h, CAST(2 * was - 1 AS BIGINT), CAST(2 * (a - was) AS BIGINT)), '' ORDER BY a) AS kept FROM e JOIN x USING (doc_id) GROUP BY e.doc_id)
    SELECT doc_id, n AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(from_hex(kept)) AS kept_sha256
    FROM x LEFT JOIN c USING (doc_id) JOIN k USING (doc_id)""",
)
def _(spark, d):
    return suffixes.remove_repeats(table(spark, d, "documents"))


@query(
    "op4_nearest",
    """WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
        WHERE vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding) AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
      s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v) AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 20 = 0),
      r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank, vec_id, score FROM s)
    SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20""",
)
def _(spark, d):
    return vptree.nearest(table(spark, d, "embeddings"))


@query(
    "op1_line_templates",
    """WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS no FROM documents),
      t AS (SELECT doc_id, no, line, list_transform(regexp_extract_all(line, '[^\\x20\\x09-\\x0D]+'), lambda w: CASE WHEN regexp_matches(w, '[0-9]') THEN '<*>' ELSE w END) AS w FROM l),
      f AS (SELECT *, len(w) AS size, array_to_string(w, ' ') AS s, len(w) || ' ' || array_to_string(w[1:3], ' ') AS leaf FROM t WHERE len(w) > 0),
      n AS (SELECT s, leaf, any_value(w) AS w, count(DISTINCT doc_id) AS n FROM f GROUP BY s, leaf),
      p AS (SELECT s, leaf, n, unnest(w) AS word, generate_subscripts(w, 1) AS pos FROM n),
      q AS (SELECT leaf, pos, word FROM p WHERE pos > 3 GROUP BY ALL HAVING sum(n) >= 10),
      m AS (SELECT p.s, p.pos, CASE WHEN p.pos <= 3 OR q.word IS NOT NULL THEN p.word ELSE '<*>' END AS word FROM p LEFT JOIN q ON q.leaf = p.leaf AND q.pos = p.pos AND q.word = p.word),
      u AS (SELECT s, string_agg(word, ' ' ORDER BY pos) AS template, count(*) AS size, count(*) FILTER (WHERE word <> '<*>') AS fixed FROM m GROUP BY s),
      d AS (SELECT s, template FROM u WHERE fixed = size OR (fixed >= 4 AND fixed >= 0.7 * size)),
      r AS (SELECT template FROM f JOIN d USING (s) GROUP BY template HAVING count(DISTINCT doc_id) >= 10),
      x AS (SELECT s, template FROM d JOIN r USING (template)),
      g AS (SELECT t.doc_id, t.no, t.line, len(t.w) > 0 AS worded, x.template FROM t LEFT JOIN x ON x.s = array_to_string(t.w, ' ') AND len(t.w) > 0)
    SELECT doc_id, count(*) FILTER (WHERE worded) AS n_lines, count(template) AS n_dropped, count(DISTINCT template) AS n_templates,
      sha256(coalesce(string_agg(line, chr(10) ORDER BY no) FILTER (WHERE template IS NULL), '')) AS kept_sha256 FROM g GROUP BY doc_id""",
)
def _(spark, d):
    kept = line_templates.drop_recurring_lines(table(spark, d, "documents"))
    return kept.withColumn("kept_sha256", F.sha2(F.coalesce("kept", F.lit("")), 256)).drop("kept")


@query(
    "op11_fm_index",
    """WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
      s AS (SELECT doc_id, p, md5_number(array_to_string(w[p:p + 49], ' ')) AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS p FROM d WHERE len(w) >= 50)),
      f AS (SELECT s, min(doc_id) AS first FROM s GROUP BY s),
      g AS (SELECT doc_id, p FROM s JOIN f USING (s) WHERE doc_id > first),
      c AS (SELECT doc_id, list(DISTINCT q) AS gone, any_value(n) AS n_windows FROM (SELECT doc_id, unnest(range(p, p + 50)) AS q, count(*) OVER (PARTITION BY doc_id) AS n FROM g) GROUP BY doc_id)
    SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(len(gone), 0) AS BIGINT) AS n_removed, CAST(coalesce(n_windows, 0) AS BIGINT) AS n_windows,
      sha256(coalesce(array_to_string(list_filter(w, lambda x, i: NOT list_contains(coalesce(gone, []), i)), ' '), '')) AS kept_sha256 FROM d LEFT JOIN c USING (doc_id)""",
)
def _(spark, d):
    return fm_index.remove_repeats(table(spark, d, "documents"))


def _crc32(text: str) -> str:
    """CRC-32 of an ASCII or UTF-8 string in SQL, a byte at a time over its hexadecimal form."""
    byte = "CAST('0x' || b AS BIGINT)"
    return f"xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all(hex(encode({text})), '..'), lambda b: {byte})), lambda a, b: xor(a >> 8, crc[(xor(a, b) & 255) + 1])))"


# the table of CRC-32, by its rule: eight times shift right, with the polynomial where a one falls out
_CRC_TABLE = "list_transform(range(256), lambda i: list_reduce(list_prepend(i::BIGINT, range(8)), lambda a, b: xor(a >> 1, CASE WHEN a & 1 = 1 THEN 3988292384 ELSE 0 END)))"


@query(
    "op12_conversation_trie",
    f"""WITH RECURSIVE k AS (SELECT {_CRC_TABLE} AS crc),
      t AS (SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS pos, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
      h AS (SELECT c, c - c % 100 AS base, {_crc32("CAST(c AS VARCHAR)")} % 6 AS h FROM (SELECT DISTINCT c FROM t), k),
      r AS (SELECT h.c, 0 AS part, pos, role, text FROM h JOIN t ON t.c = h.base AND t.pos <= h UNION ALL SELECT h.c, 1, pos, role, text FROM h JOIN t ON t.c = h.c AND t.pos > h),
      o AS (SELECT *, row_number() OVER (PARTITION BY c ORDER BY part, pos) AS d, md5(len(role) || ':' || role || text) AS id FROM r),
      p AS (SELECT c, d, len(text) AS n, md5(string_agg(id, ' ') OVER (PARTITION BY c ORDER BY d)) AS x FROM o UNION ALL SELECT c, 0, 0, 'root' FROM h),
      q AS (SELECT *, lag(x) OVER (PARTITION BY c ORDER BY d) AS up, d = max(d) OVER (PARTITION BY c) AS last FROM p),
      v AS (SELECT x, any_value(up) AS up, min(c) AS conv_id, any_value(d) AS depth, count(*) AS n_convs, any_value(n) AS n, sha256(coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (WHERE last), '')) AS ends_sha256 FROM q GROUP BY x),
      b AS (SELECT up AS x, count(*) AS n_children FROM v WHERE up IS NOT NULL GROUP BY up),
      u AS (SELECT a.x, sum((v.n_convs - 1) * v.n) AS saved, count(*) FILTER (WHERE b.x IS NULL) AS leaves FROM v LEFT JOIN b USING (x) JOIN q a ON a.c = v.conv_id AND a.d <= v.depth GROUP BY a.x)
    SELECT v.conv_id, CAST(v.depth AS BIGINT) AS depth, w.conv_id AS parent_conv_id, v.n_convs, CAST(coalesce(b.n_children, 0) AS BIGINT) AS n_children, CAST(u.leaves AS BIGINT) AS n_leaves, CAST(u.saved AS BIGINT) AS saved_tokens, v.ends_sha256
    FROM v LEFT JOIN v w ON w.x = v.up LEFT JOIN b ON b.x = v.x JOIN u ON u.x = v.x""",
)
def _(spark, d):
    return conversation_trie.conversation_trie(table(spark, d, "conversations"))


@query(
    "op13_spelling_variants",
    f"""WITH RECURSIVE k AS (SELECT {_CRC_TABLE} AS crc),
      r AS (SELECT doc_id, unnest(regexp_extract_all({_LOW}, '[A-Za-z\u00C0-\u00FF]+')) AS run FROM documents),
      g AS (SELECT run, {_crc32("coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run")} AS h FROM r, k WHERE len(run) >= 5),
      w AS (SELECT CASE WHEN h % 97 = 0 THEN substr(run, 1, h % len(run)) || substr(run, h % len(run) + 2) ELSE run END AS word FROM g),
      v AS (SELECT word, count(*) AS n FROM w WHERE len(word) >= 5 GROUP BY word HAVING count(*) >= 3),
      x AS (SELECT word, n, i, substr(word, 1, i) || substr(word, i + 2) AS s FROM (SELECT word, n, unnest(range(len(word))) AS i FROM v)),
      e AS (SELECT a.word, b.word AS near, b.n FROM x a JOIN x b ON a.s = b.s AND a.i = b.i AND a.word <> b.word
            UNION SELECT v.word, x.word, x.n FROM x JOIN v ON x.s = v.word UNION SELECT x.word, v.word, v.n FROM x JOIN v ON x.s = v.word),
      m AS (SELECT word, count(*) AS n_near, max(n) AS most FROM e GROUP BY word),
      f AS (SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN most >= 2 * v.n THEN (SELECT min(near) FROM e WHERE e.word = v.word AND e.n = most) END AS form FROM v LEFT JOIN m USING (word)),
      c AS (SELECT word, word AS root, form AS next FROM f UNION ALL SELECT c.word, f.word, f.form FROM c JOIN f ON f.word = c.next)
    SELECT f.word, f.form, c.root, f.n, CAST(f.n_near AS BIGINT) AS n_near, v.n AS form_n FROM f JOIN c ON c.word = f.word AND c.next IS NULL LEFT JOIN v ON v.word = f.form""",
)
def _(spark, d):
    return spelling.spelling_variants(table(spark, d, "documents"))
