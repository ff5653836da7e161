"""Operators against brute force and hand-made cases."""

import itertools
import math
import random
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from checks import queries
from quarry.functions import constants as K
from quarry.operators import catalog, evaluation, feed, index, query_facets, ranking, spelling, substrings, understanding, vocabulary
from quarry.session import materialize, size_tables
from quarry.sources import index_store


def osa(a: str, b: str) -> int:
    d = [[max(i, j) if 0 in (i, j) else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
    for i, j in itertools.product(range(1, len(a) + 1), range(1, len(b) + 1)):
        d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
        if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
            d[i][j] = min(d[i][j], d[i - 2][j - 2] + 1)
    return d[-1][-1]


def lcs(a: str, b: str) -> int:
    row = [0] * (len(b) + 1)
    for ch in a:
        previous = row[:]
        for j, other in enumerate(b, 1):
            row[j] = previous[j - 1] + 1 if ch == other else max(previous[j], row[j - 1])
    return row[-1]


@pytest.fixture(scope="module")
def words(spark):
    rng = random.Random(7)
    pool = ["".join(rng.choices("abcd", k=rng.randint(4, 11))) for _ in range(400)]
    terms = sorted(set(pool[:300]))
    tokens = sorted(set(pool[300:]) - set(terms))
    dictionary = spark.createDataFrame(
        [(t, 1 + i % 9, "token") for i, t in enumerate(terms)], "term string, doc_freq int, term_type string"
    )
    unknown = spark.createDataFrame([(t, "token") for t in tokens], "token string, wanted_type string")
    return tokens, terms, unknown, dictionary


def test_near_terms_equal_brute_force(words):
    tokens, terms, unknown, dictionary = words
    found = {(r.token, r.term): r.distance for r in spelling.near_terms(unknown, dictionary).collect()}
    expected = {(a, b): osa(a, b) for a in tokens for b in terms if osa(a, b) <= 2}
    assert found == expected


def test_similar_terms_equal_brute_force(words):
    tokens, terms, unknown, dictionary = words
    found = spelling.similar_terms(unknown, dictionary, limit=1000).collect()
    expected = {
        (a, b): 2 * lcs(a, b) / (len(a) + len(b)) for a in tokens for b in terms
        if 20 * lcs(a, b) >= 7 * 2 * (len(a) + len(b)) / 2
    }
    assert {(r.token, r.term): r.raw_score for r in found} == pytest.approx(expected)


def test_similar_pairs_are_few_and_none_is_lost(spark):
    rng = random.Random(23)
    parts = ["ла", "сти", "ро", "мен", "ку", "вар", "о", "пре", "шт", "ние", "би", "ён", "g", "za", "11"]
    make = lambda: "".join(rng.choices(parts, k=rng.randint(1, 7)))
    terms = sorted({make() for _ in range(900)} | {"а", "аа", "x" * 60, "ab" * 20})
    tokens = sorted({make() for _ in range(60)} | {"а", "ааа", "x" * 45, "ab" * 21, "ba" * 17})
    dictionary = spark.createDataFrame([(t, 1, "token") for t in [*terms, ""]], "term string, doc_freq int, term_type string")
    unknown = spark.createDataFrame([(t,) for t in [*tokens, "", tokens[0], None]], "token string")
    pairs = {(r.token, r.term) for r in spelling.similar_pairs(unknown, dictionary).collect()}
    true = {(a, b) for a in tokens for b in terms if 20 * lcs(a, b) >= 7 * (len(a) + len(b))}
    assert true <= pairs and len(pairs) < 0.05 * len(tokens) * len(terms)
    assert spelling.similar_terms(unknown.limit(0), dictionary).count() == 0


def test_suggestions_prefer_edits_then_similarity(spark):
    dictionary = spark.createDataFrame(
        [("рабочая", 120, "token"), ("наушники", 90, "token"), ("smartbuy", 500, "brand")],
        "term string, doc_freq int, term_type string",
    )
    unknown = spark.createDataFrame(
        [("ребочая", "token"), ("наушнеки", "token"), ("smartbu", "brand"), ("smrtbyyx", "token")],
        "token string, wanted_type string",
    )
    best = {r.token: r for r in spelling.suggest(unknown, dictionary).filter("rank = 1").collect()}
    assert best["ребочая"].term == "рабочая" and best["ребочая"].distance == 1
    assert best["наушнеки"].term == "наушники" and best["smartbu"].term == "smartbuy"
    assert best["smrtbyyx"].source == "similarity"


def brute_bm25(docs, terms, prefix=False):
    n, avg = len(docs), sum(map(len, docs.values())) / len(docs)
    score = {}
    for term in terms:
        match = (lambda w: w.startswith(term)) if prefix else (lambda w: w == term)
        tfs = {d: sum(map(match, ws)) for d, ws in docs.items()}
        df = sum(1 for tf in tfs.values() if tf)
        idf = math.log((n - df + 0.5) / (df + 0.5)) if df else 0
        idf = idf if idf > 0 else 1e-6
        for d, tf in tfs.items():
            if tf:
                gain = idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(docs[d]) / avg))
                score[d] = score.get(d, 0) - gain
    return score


@pytest.mark.parametrize("threshold", ["1000", "3"])
def test_three_level_retrieval_equals_brute_force(spark, monkeypatch, threshold):
    spark.conf.set("spark.sql.optimizer.windowGroupLimitThreshold", threshold)
    monkeypatch.setattr(index, "BLOCK_BITS", 2)
    rng = random.Random(3)
    vocabulary_words = ["alpha", "beta", "gamma", "delta", "alpine", "betray", "omega"]
    docs = {f"d{i:02}": rng.choices(vocabulary_words, k=rng.randint(1, 9)) for i in range(40)}
    table = spark.createDataFrame([(k, " ".join(v)) for k, v in docs.items()], "id string, body string")
    asked = {"q1": ["alpha", "beta"], "q2": ["omega"], "q3": ["alpha", "zeta"], "q4": ["alp", "bet"], "q5": ["zzz"]}
    queries = spark.createDataFrame(list(asked.items()), "query_id string, retrieval_tokens array<string>")
    found = index.retrieve(queries, index.build_index(table, "id", "body"), 30).collect()
    for name, terms in asked.items():
        every = {d for d, ws in docs.items() if set(terms) <= set(ws)}
        exact = brute_bm25(docs, terms)
        if every:
            level, expected = 1, {d: s for d, s in exact.items() if d in every}
        elif exact and len(terms) > 1:
            level, expected = 2, exact
        else:
            level, expected = 3, brute_bm25(docs, terms, prefix=True)
        rows = sorted((r for r in found if r.query_id == name), key=lambda r: r.hit_rank)
        assert all(r.level == level and r.hit_count == len(expected) for r in rows)
        order = sorted(expected, key=lambda d: (round(expected[d], 9), d))[:30]
        assert [r.doc for r in rows] == order
        assert [r.bm25 for r in rows] == pytest.approx([expected[d] for d in order], abs=1e-8)


    spark.conf.unset("spark.sql.optimizer.windowGroupLimitThreshold")


def test_a_prefix_of_every_document_and_a_search_of_most_users(spark):
    table = spark.range(3000).select(F.concat(F.lit("d"), F.col("id")).alias("id"), F.concat(F.lit("common"), F.col("id") % 50, F.lit(" word")).alias("body"))
    queries = spark.range(400).select(
        F.concat(F.lit("q"), F.col("id")).alias("query_id"),
        F.when(F.col("id") % 10 > 0, F.array(F.lit("comm"))).otherwise(F.array(F.concat(F.lit("common"), (F.col("id") / 10).cast("int")))).alias("retrieval_tokens"),
    )
    found = index.retrieve(queries, index.build_index(table, "id", "body"), 20)
    rows = {(r.level, r.hit_count, r.n): r["count"] for r in found.groupBy("query_id", "level", "hit_count").agg(F.count("*").alias("n")).groupBy("level", "hit_count", "n").count().collect()}
    assert rows == {(3, 3000, 20): 360, (1, 60, 20): 40}


@pytest.fixture(scope="module")
def hot_terms(spark):
    """Texts of two hot words, which stand together in one tenth of them and often in a few."""
    return spark.range(4000).select(
        F.concat(F.lit("d"), F.lpad(F.col("id").cast("string"), 5, "0")).alias("id"),
        F.concat_ws(
            " ", F.when(F.col("id") % 400 < 8, F.repeat(F.lit("hot warm "), 1 + (F.col("id") % 3).cast("int"))),
            F.when(F.col("id") % 10 > 0, F.lit("hot")), F.when(F.col("id") % 10 < 2, F.lit("warm")),
            F.repeat(F.concat(F.lit("filler"), F.col("id") % 7, F.lit(" ")), 3 + (F.col("id") % 5).cast("int")),
        ).alias("body"),
    )


def test_bounded_retrieval_equals_full_and_leaves_blocks_unread(spark, hot_terms, monkeypatch):
    monkeypatch.setattr(index, "BLOCK_BITS", 4)
    built = index.build_index(hot_terms, "id", "body")
    searches = spark.createDataFrame([(1, ["hot", "warm"]), (2, ["warm", "absent"]), (3, ["hot"])], "search long, terms array<string>")
    weighed = index.weighed_terms(searches, built).cache()
    blocks = index.search_blocks(weighed, built).cache()
    for whole in (True, False):
        mine = blocks.filter("size(held) = n_terms") if whole else blocks
        found = index.bounded_hits(mine, built, 10, whole)
        full = ranking.top_k(index.block_hits(mine, built, whole), ["search"], [F.asc("bm25"), F.asc("doc")], 10, rank="hit_rank")
        rows = lambda df: sorted(map(tuple, df.select("search", "hit_rank", "doc", "bm25").collect()))
        assert rows(found.best) == rows(full)
        read = sum(b.filter("search = 1").count() for b in found.read)
        assert read < mine.filter("search = 1").count() / 3
        counts = {r.search: r.hit_count for r in index._hit_counts(found, weighed, built, whole).collect()}
        exact = {r.search: r["count"] for r in index.block_hits(mine, built, whole).groupBy("search").count().collect()}
        assert counts == exact


def test_added_segments_equal_a_fresh_index(spark, hot_terms, monkeypatch):
    monkeypatch.setattr(index, "BLOCK_BITS", 4)
    changed = hot_terms.filter("substr(id, 5, 2) in ('07', '40', '41')")
    older = hot_terms.join(changed, "id", "left_anti").unionByName(changed.filter("id like '%07'").withColumn("body", F.lit("warm stale words")))
    older = older.unionByName(spark.createDataFrame([("gone", "hot warm gone")], "id string, body string"))
    first = index.build_index(older, "id", "body")
    gone = spark.createDataFrame([("gone",)], "doc string")
    named = changed.toDF("doc", "words")
    second = index.add_segment(first, named.filter("doc like '%07'"), gone)
    third = index.add_segment(second, named, gone)
    fresh = index.build_index(hot_terms, "id", "body")
    merged = index.merge_segments(third)
    queries = spark.createDataFrame(
        [("a", ["hot", "warm"]), ("b", ["stale", "filler3"]), ("c", ["gone"]), ("d", ["fill"]), ("e", ["hot"])], "query_id string, retrieval_tokens array<string>"
    )
    rows = lambda built: sorted(map(str, index.retrieve(queries, built, 25).collect()))
    assert rows(third) == rows(fresh) == rows(merged)
    for built in (third, merged):
        assert built.stats.first() == fresh.stats.first()
        assert sorted(built.terms.collect()) == sorted(fresh.terms.collect())
        assert sorted(map(str, built.postings.collect())) == sorted(map(str, fresh.postings.collect()))


def below_joins(plan: str) -> list[tuple[str, list[str]]]:
    """Each scan of a plan's text with the operators between it and the nearest join above."""
    path, found = [], []
    for line in plan.splitlines():
        name = line.lstrip(" :+-*()0123456789")
        depth = len(line) - len(line.lstrip(" :+-"))
        path = [(d, n) for d, n in path if d < depth] + [(depth, name)]
        if "FileScan" in name:
            above = [n for _, n in path[:-1]]
            last = max((i for i, n in enumerate(above) if "Join" in n), default=-1)
            found.append((name, above[last + 1 :]))
    return found


def test_stored_index_is_joined_without_moving_it(spark, hot_terms, tmp_path):
    index_store.write_index(spark, f"{tmp_path}/1", hot_terms, "id", "body")
    newer = hot_terms.filter("id <> 'd00007'").withColumn("body", F.when(F.col("id").endswith("9"), F.lit("hot news")).otherwise(F.col("body")))
    index_store.update_index(spark, f"{tmp_path}/1", f"{tmp_path}/2", hot_terms, newer, "id", "body")
    loaded = index_store.load_index(spark, f"{tmp_path}/2")
    fresh = index.build_index(newer, "id", "body")
    queries = spark.createDataFrame([("a", ["hot", "news"]), ("b", ["warm"]), ("c", ["fil"])], "query_id string, retrieval_tokens array<string>")
    rows = lambda built: sorted(map(str, index.retrieve(queries, built, 30).collect()))
    assert rows(loaded) == rows(fresh)
    searches = spark.createDataFrame([(1, ["hot", "news"])], "search long, terms array<string>")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        weighed = index.weighed_terms(searches, loaded)
        blocks = index.search_blocks(weighed, loaded)
        chosen = spark.createDataFrame(blocks.collect(), blocks.schema)
        for df, stored in ((weighed, 2), (blocks, 4), (index.block_hits(chosen, loaded, False), 2)):
            scans = [above for name, above in below_joins(df._jdf.queryExecution().executedPlan().toString()) if "Bucketed: true" in name]
            assert len(scans) >= stored and not [op for above in scans for op in above if op.startswith("Exchange")]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_training_cases_are_the_purchases_loaded_last(spark):
    rows = [("a", "2024-01-01", "2025-02-02"), ("b", "2025-01-01", "2025-02-01"), ("c", "2023-01-01", "2025-02-02"), ("d", None, None)]
    purchases = spark.createDataFrame(
        [(k, "1", f"name {k}", f"title {k}", f"p{k}", day, load) for k, day, load in rows],
        "contract_key string, customer_inn string, purchase_name_raw string, title_raw string, ste_id string, contract_date string, updated_at string",
    )
    in_order = lambda df, n: [r.query_id[0] for r in evaluation.training_cases(df, n).orderBy("case_no").collect()]
    assert in_order(purchases, 3) == ["a", "c", "b"]
    assert in_order(purchases.drop("updated_at"), 3) == ["b", "a", "c"]


def test_salted_top_k_is_exact(spark):
    rows = spark.range(5000).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("key"),
        (F.col("id") * 7919 % 5003).alias("v"), "id",
    )
    spark.conf.set("spark.sql.optimizer.windowGroupLimitThreshold", "10")
    cut = ranking.top_k(rows, ["key"], [F.desc("v")], 50, spread_by="id")
    got = [r.v for r in cut.filter("key = 'hot'").orderBy("rank").collect()]
    spark.conf.unset("spark.sql.optimizer.windowGroupLimitThreshold")
    assert got == sorted((i * 7919 % 5003 for i in range(0, 5000, 3)), reverse=True)[:50]


def test_upsert_keeps_first_and_takes_last(spark):
    base = spark.createDataFrame([("a", "old", "t0", 1)], "k string, v string, created string, n int")
    delta = spark.createDataFrame(
        [("a", "new", "t1", 2), ("a", "newest", "t2", 3), ("b", "b", "t3", 2)],
        "k string, v string, created string, n int",
    )
    rows = {r.k: (r.v, r.created) for r in catalog.upsert(base, delta, "k", "n", ["created"]).collect()}
    assert rows == {"a": ("newest", "t0"), "b": ("b", "t3")}


def test_interleaving_follows_the_cycle(spark):
    def loop(history, category, popular):
        out, buckets = [], [list(history), list(category), list(popular)]
        while any(buckets):
            for b in (0, 1, 0, 2):
                if buckets[b]:
                    out.append(buckets[b].pop(0))
        return out

    rng = random.Random(5)
    rows, expected = [], {}
    for c in range(20):
        sizes = [rng.randint(0, 7) for _ in range(3)]
        names = [[f"{kind}{i}" for i in range(n)] for kind, n in zip("hcp", sizes)]
        expected[str(c)] = loop(*names)
        flat = sum(names, [])
        rng.shuffle(flat)
        ordered = sorted(flat, key=lambda x: int(x[1:]))
        rows += [
            (str(c), x, rank, float(x[0] == "h"), float(x[0] == "c"))
            for rank, x in enumerate(ordered, 1)
        ]
    ranked = spark.createDataFrame(
        rows, "customer_inn string, ste_id string, rank int, history_weight double, category_weight double"
    )
    got = {}
    for r in feed.interleave_feed(ranked).orderBy("customer_inn", "rank").collect():
        got.setdefault(r.customer_inn, []).append(r.ste_id)
    assert got == {c: items for c, items in expected.items() if items}


def test_ranking_metrics(spark):
    cases = spark.createDataFrame([("1", "a"), ("2", "b"), ("3", "c")], "query_id string, expected string")
    results = spark.createDataFrame(
        [("1", "a", 1), ("2", "x", 1), ("2", "b", 7)], "query_id string, ste_id string, rank int"
    )
    m = evaluation.ranking_metrics(results, cases).first()
    assert m.mrr10 == round((1 + 1 / 7) / 3, 4) and m.recall20 == 0.6667 and m.success5 == 0.3333
    assert m.ndcgAt10 == round((1 + 1 / math.log2(8)) / 3, 4) and not m.is_reliable


def test_pairwise_ranker_learns_the_separating_feature(spark):
    rows = []
    for q in range(30):
        rows.append((str(q), 1, [1.0, 0.0]))
        rows += [(str(q), 0, [0.0, float(q % 2)]) for _ in range(3)]
    groups = spark.createDataFrame(rows, "query_id string, label int, features array<double>")
    first, second = evaluation.fit_ranker(groups)
    assert first > 0 and first > second
    scored = groups.withColumn("score", F.lit(1.0))
    blended = evaluation.apply_ranker(scored, [first, second]).filter("label = 1").first()
    assert blended.score == pytest.approx(0.6 + 0.4 * first, abs=1e-5)
    assert evaluation.apply_ranker(scored, []) is scored


def test_substrings_equal_brute_force(spark, tmp_path):
    rng = random.Random(5)
    draw = lambda most: "".join(rng.choices("аб 1\n", k=rng.randint(0, most)))
    rows = [(f"p{i}", draw(30), draw(12)) for i in range(150)]
    rows += [("n0", None, "абаб"), ("n1", "ааааааа", None), ("n2", None, None), ("n3", "", ""), ("n4", "аб" * 3000, "x")]
    needles = sorted({draw(9) for _ in range(200)} | {"а", "x", "аа", "ааа", "аааа", "б" * 12, "нет", "я", "абабабабаб"})
    texts = spark.createDataFrame(rows, "ste_id string, plain string, raw string")
    asked = spark.createDataFrame([(n,) for n in needles if n], "needle string")
    folder, fields = str(tmp_path / "snapshot"), ["plain", "raw"]
    index_store.write_index(spark, folder, texts, "ste_id", "plain")
    index_store.write_pieces(spark, folder, texts, "ste_id", fields)
    stored = index_store.load_pieces(spark, folder)
    found = substrings.find(asked, stored, texts, "ste_id", fields)
    hits = [(r.needle, r.ste_id) for r in found.collect()]
    expected = {(n, key) for n in needles if n for key, *cells in rows if any(n in c for c in cells if c)}
    assert len(hits) == len(set(hits)) and set(hits) == expected
    assert substrings.find(asked.limit(0), stored, texts, "ste_id", fields).count() == 0
    nothing = substrings.PieceIndex(stored.places.limit(0), stored.counts.limit(0))
    assert substrings.find(asked, nothing, texts.limit(0), "ste_id", fields).count() == 0


def test_stored_pieces_are_joined_where_they_lie(spark, tmp_path):
    texts = spark.createDataFrame([(f"p{i}", f"шина {i}", None) for i in range(40)], "ste_id string, plain string, raw string")
    folder, fields = str(tmp_path / "snapshot"), ["plain", "raw"]
    index_store.write_index(spark, folder, texts, "ste_id", "plain")
    index_store.write_pieces(spark, folder, texts, "ste_id", fields)
    asked = spark.createDataFrame([("шина 1",), ("на",)], "needle string")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = substrings.find(asked, index_store.load_pieces(spark, folder), texts, "ste_id", fields)
        executed = found._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    lines, passed = executed.splitlines(), ("Filter", "Project", "ColumnarToRow")
    scans = [at for at, line in enumerate(lines) if "FileScan parquet" in line and "place#" in line]
    assert scans
    for at in scans:
        assert "Exchange" not in next(line for line in reversed(lines[:at]) if not any(w in line for w in passed))
    assert "Generate explode(transform" not in executed and found.count() == 51


def test_query_facets(spark):
    queries = spark.createDataFrame(
        [("1", "бескамерная шина superguider"), ("2", "ozka ind80"), ("3", "шина для мини-погрузчика 16.5"),
         ("4", "ноутбук 16 гб 14 дюймов"), ("5", "thinkpad x1 lenovo")],
        "query_id string, query string",
    )
    brands = spark.createDataFrame(
        [("Superguider", "QH603", "Шины"), ("Lenovo", "ThinkPad X1", "Ноутбуки"), ("Len", "X1", "Ноутбуки")],
        "manufacturer string, model string, category_name string",
    )
    rows = {r.query_id: r for r in query_facets.extract_query_facets(queries, brands).collect()}
    assert rows["1"].detected_category == "шина" and rows["1"].detected_brand == "Superguider"
    assert rows["1"].detected_attributes == {"Тип": "Бескамерная"}
    assert rows["2"].detected_brand == "Ozka" and rows["2"].detected_model == "IND80"
    assert rows["3"].numeric_constraints == {"Диаметр": "16.5"} and rows["3"].detected_brand is None
    assert rows["4"].numeric_constraints == {"Память": "16", "Диаметр": "14"}
    assert rows["5"].detected_brand == "Lenovo" and rows["5"].detected_model == "ThinkPad X1"
    assert rows["5"].has_structured_data
    sentence = spark.range(1).select(query_facets.match_sentence(F.lit("brand")).alias("s")).first().s
    assert sentence == K.MATCH_SENTENCES["brand"]


def test_seed_synonyms_and_expansion(spark):
    seeds = vocabulary.seed_synonyms(spark)
    dictionary = spark.createDataFrame(
        [("ноутбук", "ноутбук", 9, "token"), ("ноут", "ноут", 1, "token")],
        "term string, lemma string, doc_freq int, term_type string",
    )
    candidates = vocabulary.synonym_candidates(dictionary, seeds)
    rules = vocabulary.synonym_rules(candidates, dictionary, seeds)
    lookup = {r.word: r for r in vocabulary.expansion_lookup(rules).collect()}
    assert lookup["флешка"].canonical == "usb" and "флэшка" in lookup["usb"].aliases
    assert lookup["рабочая"].canonical == "рабочий"


def test_steps_of_spelling_are_planned_once(spark, words):
    """A plan that repeats its steps holds the broadcasts of all of them on the driver at a time."""
    tokens, _, unknown, dictionary = words
    known = dictionary.withColumn("lemma", F.col("term"))
    asked = unknown.select("token")
    for found in (spelling.suggest(unknown, known), understanding.resolve_tokens(asked, known)):
        plan = found._jdf.queryExecution().optimizedPlan().toString()
        assert "Generate" not in plan and plan.count("Join") <= 3
    resolved = {r.token for r in understanding.resolve_tokens(asked, known).collect()}
    assert resolved == set(tokens)


def test_phrases_and_their_matches_are_made_once(spark):
    """A plan with all steps broadcasts the phrases several times, from the driver."""
    goods = spark.createDataFrame([("Dell", "P2723", "Мониторы"), (None, "", "Шины")], "manufacturer string, model string, category_name string")
    asked = spark.createDataFrame([("монитор dell p2723 мониторы",), ("шины",)], "plain string")
    found = query_facets.phrase_matches(asked, query_facets.catalog_phrases(goods))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "Generate" not in plan
    assert {tuple(r) for r in found.collect()} == {
        (q, kind, v) for q, kind, v in [
            ("монитор dell p2723 мониторы", "brand", "Dell"), ("монитор dell p2723 мониторы", "model", "P2723"),
            ("монитор dell p2723 мониторы", "category", "Мониторы"), ("шины", "category", "Шины"),
        ]
    }


def test_cold_start_asks_for_the_new_customer_only(spark, monkeypatch):
    asked = []

    def recommend(customers, *_):
        asked.extend(r.customer_inn for r in customers.collect())
        return spark.createDataFrame([("p", 1.0, 1)], "ste_id string, score double, rank int")

    for name in ("search_tables", "contracts", "overlay"):
        monkeypatch.setattr(queries, name, lambda *_: SimpleNamespace(products=None))
    monkeypatch.setattr(queries.recommend_plan, "recommend", recommend)
    assert queries.cold_start_feed(spark, "").collect() == [("p", 1.0, 1)] and asked == [K.NEW_CUSTOMER]


def test_tables_are_sized_by_their_rows(spark):
    """A table whose Parquet is small but whose rows are not is no broadcast (F2 and the searches)."""
    factor, limit = "spark.sql.sources.fileCompressionFactor", "spark.sql.autoBroadcastJoinThreshold"
    before = {name: spark.conf.get(name) for name in (factor, limit)}
    try:
        spark.conf.set(factor, "1.0")
        spark.conf.set(limit, "4m")
        table = materialize(spark.range(400_000).select("id", F.lit("the same words in every row").alias("words")), "alike")
        size_tables(spark)
        kinds = table.join(spark.range(1_000_000), "id")._jdf.queryExecution().sparkPlan().toString()
        assert "SortMergeJoin" in kinds and "BroadcastHashJoin" not in kinds
        spark.conf.set(factor, "3.0")
        size_tables(spark)
        assert spark.conf.get(factor) == "3.0"
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)


def test_candidates_are_planned_from_written_hits(spark):
    """What follows retrieval is not planned together with the levels of the search."""
    texts = spark.createDataFrame([("a", "red ring"), ("b", "red bolt"), ("c", "blue ring")], "ste_id string, search_text string")
    asked = spark.createDataFrame([("q", ["red", "ring"]), ("r", ["bolt", "blue"])], "query_id string, retrieval_tokens array<string>")
    found = index.retrieve(asked, index.build_index(texts, "ste_id", "search_text"), 5)
    assert found._jdf.queryExecution().analyzed().toString().count("Relation") <= 4
    assert sorted(tuple(r) for r in found.select("query_id", "doc", "level", "hit_count").collect()) == [
        ("q", "a", 1, 1), ("r", "b", 2, 2), ("r", "c", 2, 2)
    ]


def test_only_the_first_page_of_the_feed_is_written(spark, monkeypatch):
    """The feeds behind recommend and feed_explained (F23) are cut before they are written."""
    monkeypatch.setattr(queries, "contracts", lambda s, d: spark.createDataFrame([("1",), ("1",)], "customer_inn string"))
    monkeypatch.setattr(
        queries, "feed_of", lambda s, d, askers: askers.crossJoin(spark.range(1, 101).withColumnRenamed("id", "rank"))
    )
    assert queries.first_feed(spark, "a folder that is not read").count() == 2 * queries.PAGE
