"""Registered queries of the subpackage, each over whole tables, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import contamination, conversation_repair, cover_tree, kneser_ney, language, line_dedup, mixing, periodic_runs, permutation_index, run_length_index, sampling, simhash, toxicity
from quarry.llm.text import fold

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(run):
    QUERIES[run.__name__] = run
    return run


def documents(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/documents.parquet")


@query
def op1_language(spark, d):
    docs = documents(spark, d)
    model = language.train(docs.filter(fold(F.col("doc_id")) != 0))
    return language.identify(docs, model)


@query
def op2_line_dedup(spark, d):
    return line_dedup.report(documents(spark, d))


SQL["op2_line_dedup"] = r"""
WITH l AS (
  SELECT doc_id, i - 1 AS line, string_split(text, chr(10))[i] AS t
  FROM (SELECT doc_id, text, unnest(range(1, len(string_split(text, chr(10))) + 1)) i FROM documents WHERE text IS NOT NULL)
), s AS (
  SELECT doc_id, line, list_sort(list_distinct(regexp_extract_all(lower(t), '[^\x20\x09-\x0D]+'))) w FROM l
), u AS (
  SELECT w, len(w) n, min(struct_pack(d := doc_id, l := line)) AS first FROM s WHERE len(w) > 0 GROUP BY w
), k AS (
  SELECT row_number() OVER () AS k, * FROM u
), tokens AS (
  SELECT k, n, first, unnest(w) AS t FROM k
), df AS (
  SELECT t, count(*) c FROM tokens GROUP BY t
), p AS (
  SELECT * FROM (SELECT k, n, first, t, row_number() OVER (PARTITION BY k ORDER BY c, t) AS place FROM tokens JOIN df USING (t))
  WHERE place <= n - (4 * n + 4) // 5 + 1
), c AS (
  SELECT DISTINCT a.k AS later, b.k AS earlier FROM p a JOIN p b ON a.t = b.t AND b.first < a.first AND 5 * least(a.n, b.n) >= 4 * greatest(a.n, b.n)
), m AS (
  SELECT DISTINCT later FROM c JOIN k x ON x.k = later JOIN k y ON y.k = earlier
  WHERE 9 * len(list_intersect(x.w, y.w)) >= 4 * (x.n + y.n)
), r AS (
  SELECT doc_id, list(line ORDER BY line) AS removed FROM s JOIN k USING (w)
  WHERE k IN (SELECT later FROM m) OR struct_pack(d := doc_id, l := line) <> first GROUP BY doc_id
)
SELECT doc_id, CASE WHEN text IS NULL THEN 0 ELSE len(string_split(text, chr(10))) END::INTEGER AS n_lines,
  coalesce(len(removed), 0)::INTEGER AS n_removed, coalesce(array_to_string(removed, ','), '') AS removed
FROM documents LEFT JOIN r USING (doc_id)
"""


@query
def op3_segmentations(spark, d):
    found = sampling.encode(documents(spark, d))
    return found.withColumn("ids_hash", F.xxhash64("ids")).drop("ids")


@query
def op4_kneser_ney(spark, d):
    docs = documents(spark, d)
    remainder = fold(F.col("doc_id"))
    model = kneser_ney.train(docs.filter(remainder != 1))
    return kneser_ney.score(docs.withColumn("held_out", F.coalesce(remainder == 1, F.lit(False))), model)


@query
def op5_permutation_index(spark, d):
    return permutation_index.nearest(spark.read.parquet(f"{d}/embeddings.parquet"), F.col("vec_id") % 20 == 0)


@query
def op7_toxicity(spark, d):
    docs = documents(spark, d)
    model = toxicity.train(docs, toxicity.learnable(spark.read.parquet(f"{d}/labels.parquet")))
    return toxicity.score(docs, model)


@query
def op8_cover_tree(spark, d):
    return cover_tree.top_k(spark.read.parquet(f"{d}/embeddings.parquet"), F.col("vec_id") % 100 == 0)


SQL["op8_cover_tree"] = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id query_id, c.vec_id, CAST(list_sum(list_transform(range(1, len(q.e) + 1), lambda i: q.e[i] * c.e[i])) AS BIGINT) score
  FROM v q JOIN v c ON c.vec_id <> q.vec_id WHERE q.vec_id % 100 = 0
), r AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) n FROM s
)
SELECT query_id, CAST(n AS INTEGER) AS rank, vec_id, score FROM r WHERE n <= 10
"""


@query
def op9_run_length_index(spark, d):
    return run_length_index.remove_repeats(documents(spark, d)).drop("kept")


@query
def op10_mixing(spark, d):
    return mixing.mix(documents(spark, d)).drop("copies", "key")


@query
def op6_simhash(spark, d):
    return simhash.near_duplicates(documents(spark, d))


@query
def op13_decontamination(spark, d):
    return contamination.report(documents(spark, d), spark.read.parquet(f"{d}/benchmark.parquet"))


SQL["op13_decontamination"] = r"""
WITH b AS (
  SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w
  FROM benchmark WHERE text IS NOT NULL
), g AS (
  SELECT DISTINCT item_id, least(len(w), 10) n, array_to_string(w[i : i + least(len(w), 10) - 1], ' ') t
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 8, 2))) i FROM b WHERE len(w) > 0)
), d AS (
  SELECT row_number() OVER () AS k, doc_id,
    coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) w
  FROM documents
), p AS (
  SELECT k, n, i, array_to_string(w[i : i + n - 1], ' ') t
  FROM (SELECT k, w, n, unnest(range(1, len(w) - n + 2)) i FROM d, (SELECT DISTINCT n FROM g))
), m AS (
  SELECT DISTINCT k, n, i, t FROM p SEMI JOIN g USING (n, t)
), h AS (
  SELECT k, count(DISTINCT x) n_hit FROM (SELECT k, unnest(range(i, i + n)) x FROM m) GROUP BY k
), l AS (
  SELECT k, count(*) n_items, string_agg(item, ',' ORDER BY item) items
  FROM (SELECT DISTINCT k, CAST(item_id AS VARCHAR) item FROM m JOIN g USING (n, t) WHERE item_id IS NOT NULL) GROUP BY k
)
SELECT doc_id, CAST(len(w) AS BIGINT) n_words, coalesce(n_hit, 0) n_hit, coalesce(n_items, 0) n_items,
  sha256(coalesce(items, '')) items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (k) LEFT JOIN l USING (k)
"""


@query
def op12_conversation_repair(spark, d):
    rows = spark.read.parquet(f"{d}/conversations.parquet")
    return conversation_repair.report(rows, conversation_repair.damaged(rows))


_CRC_TABLE = """crc AS (
  SELECT list_transform(range(256), lambda i: list_reduce(
    range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, CAST(i AS BIGINT))) t
)"""


def _crc32(column: str) -> str:
    """CRC-32 of an ASCII string, by the table of ``_CRC_TABLE``."""
    codes = f"list_transform(range(1, len({column}) + 1), lambda k: CAST(ascii(substr({column}, k, 1)) AS BIGINT))"
    return f"xor(list_reduce({codes}, lambda c, b: xor(c >> 8, t[xor(c & 255, b) + 1]), 4294967295), 4294967295)"


def _dearer(way: str, cost: str, letter: str) -> str:
    """A way, as nine digits of cost and its letters, after one more edit."""
    return f"format('{{:09d}}', CAST(left({way}, 9) AS BIGINT) + {cost}) || substr({way}, 10) || '{letter}'"


def _one_turn() -> str:
    """The cheapest ways to the four states after one turn (gone, initial, more), before further inserted ones."""
    def stays(state: int, cost: str, letter: str, only: str = "TRUE") -> str:
        return f"CASE WHEN NOT gone AND {only} THEN {_dearer(f's{state}', cost, letter)} END"

    def to(state: int, initial: str, given: tuple[int, ...], made: bool = True) -> str:
        ways = [_dearer(f"s{state}", "2", "D")] + [stays(g, "more", "K", f"initial = '{initial}'") for g in given]
        ways += [stays(g, "1 + more", "R") for g in given if made]
        return f"least({', '.join(ways)}) AS s{state}"

    return ", ".join([f"{_dearer('s0', '2', 'D')} AS s0", to(1, "s", (0,), False), to(2, "u", (0, 1, 3)), to(3, "a", (2,))])


def _with_inserts(ways: str) -> str:
    """The ways of a subquery (conv_id, i, s0 to s3), also with turns inserted after them."""
    to_user = ", ".join(_dearer(s, "5", "I") for s in ("s0", "s1", "s3"))
    return f"""
    SELECT conv_id, i, s0, s1, least(u, {_dearer('a', '5', 'I')}) AS s2, a AS s3 FROM (
      SELECT *, least(s3, {_dearer('u', '5', 'I')}) AS a FROM (SELECT *, least(s2, {to_user}) AS u FROM ({ways}))
    )"""


SQL["op12_conversation_repair"] = rf"""
WITH RECURSIVE {_CRC_TABLE}, c AS (
  SELECT *, {_crc32('name')} % 20 AS fault FROM crc, (
    SELECT *, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS name FROM conversations
  )
), d AS (
  SELECT conv_id, turn, CASE fault WHEN 4 THEN 'user' ELSE coalesce(role, ' ') END AS role,
    CASE fault WHEN 1 THEN '' WHEN 2 THEN regexp_replace(coalesce(text, ' '), '[.!?]', '', 'g') ELSE coalesce(text, ' ') END AS text,
    unnest(CASE fault WHEN 3 THEN [1, 2] ELSE [1] END) AS copy
  FROM c WHERE fault <> 0
), r AS (
  SELECT conv_id, turn, role, text, left(role, 1) AS initial, row_number() OVER w AS i, lag(left(role, 1)) OVER w AS previous,
    CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank'
      WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) > 1 THEN 'duplicate'
      WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') THEN 'truncated' END AS fault
  FROM d WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text), copy)
), n AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) AS n,
    count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
    count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (previous || initial NOT IN ('su', 'ua', 'au')) AS illegal
  FROM r GROUP BY conv_id
), turns AS (
  SELECT conv_id, i, initial, coalesce(fault IN ('blank', 'duplicate'), FALSE) AS gone, CASE WHEN fault = 'truncated' THEN 5 ELSE 0 END AS more FROM r
), ways AS (
  {_with_inserts("SELECT conv_id, CAST(0 AS BIGINT) AS i, '000000000' AS s0, CAST(NULL AS VARCHAR) AS s1, CAST(NULL AS VARCHAR) AS s2, CAST(NULL AS VARCHAR) AS s3 FROM n")}
  UNION ALL
  {_with_inserts(f"SELECT t.conv_id, t.i, {_one_turn()} FROM ways w JOIN turns t ON t.conv_id IS NOT DISTINCT FROM w.conv_id AND t.i = w.i + 1")}
), best AS (
  SELECT w.conv_id, CAST(left(least(s0, s3), 9) AS BIGINT) AS cost, substr(least(s0, s3), 10) AS audit
  FROM ways w JOIN n ON n.conv_id IS NOT DISTINCT FROM w.conv_id AND n.n = w.i
), letters AS (
  SELECT conv_id, k, audit[k] AS letter, len(replace(audit[1 : k], 'I', '')) AS used
  FROM (SELECT *, unnest(range(1, len(audit) + 1)) AS k FROM best)
), kept AS (
  SELECT l.conv_id, l.k, l.letter, r.role, CASE WHEN l.letter = 'I' THEN '' ELSE r.text END AS text,
    row_number() OVER (PARTITION BY l.conv_id ORDER BY l.k)
      - max(CASE WHEN l.letter = 'K' AND r.initial = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY l.conv_id) AS m
  FROM letters l LEFT JOIN r ON r.conv_id IS NOT DISTINCT FROM l.conv_id AND r.i = l.used WHERE l.letter <> 'D'
), lines AS (
  SELECT conv_id, string_agg(CASE WHEN letter = 'K' THEN role WHEN m % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || text, chr(10) ORDER BY k) AS lines
  FROM kept GROUP BY conv_id
), ids AS (
  SELECT DISTINCT conv_id FROM conversations
)
SELECT ids.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
  coalesce(illegal, 0) AS illegal, coalesce(cost, 0) AS cost, coalesce(audit, '') AS audit, sha256(coalesce(lines, '')) AS repaired_sha256
FROM ids LEFT JOIN n ON n.conv_id IS NOT DISTINCT FROM ids.conv_id LEFT JOIN best ON best.conv_id IS NOT DISTINCT FROM ids.conv_id
  LEFT JOIN lines ON lines.conv_id IS NOT DISTINCT FROM ids.conv_id
"""


@query
def op11_periodic_runs(spark, d):
    return periodic_runs.report(periodic_runs.planted(documents(spark, d)))


SQL["op11_periodic_runs"] = rf"""
WITH {_CRC_TABLE}, d AS (
  SELECT row_number() OVER () AS k, doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w, {_crc32('name')} AS h
  FROM crc, (SELECT *, CAST(doc_id AS VARCHAR) AS name FROM documents)
), p AS (
  SELECT *, 1 + (len(w) - a) // (3 + (h // 10) % 8) AS p FROM (SELECT *, CASE WHEN len(w) > 0 THEN (h // 10) % len(w) END AS a FROM d)
), m AS (
  SELECT k, doc_id, CASE WHEN h % 10 = 0 AND len(w) > 0
    THEN list_transform(range(len(w)), lambda i: w[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % p END]) ELSE w END AS w FROM p
), g AS (
  SELECT k, i, hash(w[i + 1 : i + 6]) AS g FROM (SELECT k, w, unnest(range(0, len(w) - 5)) AS i FROM m)
), e AS (
  SELECT x.k, x.i, y.i - x.i AS q FROM g x JOIN g y ON x.k = y.k AND x.g = y.g AND x.i < y.i
), s AS (
  SELECT k, q, min(i) AS s, count(*) + 5 + q AS n FROM (SELECT *, i - row_number() OVER (PARTITION BY k, q ORDER BY i) AS island FROM e) GROUP BY k, q, island
), r AS (
  SELECT k, s, n, min(q) AS q FROM s WHERE n >= greatest(12, 2 * q) GROUP BY k, s, n
), o AS (
  SELECT k, count(*) AS n_runs, max(struct_pack(n := n, s := -s, q := -q)) AS top, string_agg(s || ',' || n || ',' || q || chr(10), '' ORDER BY s, q) AS lines
  FROM r GROUP BY k
), dropped AS (
  SELECT k, list(i) AS gone FROM (SELECT DISTINCT k, unnest(range(s + q, s + n)) AS i FROM r) GROUP BY k
), kept AS (
  SELECT k, string_agg(word, ' ' ORDER BY i) AS words
  FROM (SELECT m.k, unnest(w) AS word, unnest(range(len(w))) AS i FROM m) ANTI JOIN (SELECT k, unnest(gone) AS i FROM dropped) USING (k, i) GROUP BY k
)
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, -top.s AS start, top.n AS length, -top.q AS period, 1000 * top.n // -top.q AS exponent_milli,
  sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(words, '')) AS collapsed_sha256
FROM m LEFT JOIN o USING (k) LEFT JOIN kept USING (k)
"""
