"""Loads, search, feed, events and streams over the small catalogue."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from quarry.functions import constants as K
from quarry.operators import catalog, facets, feed, index, ranking, signals, understanding
from quarry.operators.scoring import Overlay
from quarry.plans import recommend as recommend_plan
from quarry.plans import search as search_plan
from quarry.sources import files, store
from quarry.streaming import ingest as ingest_streaming
from quarry.streaming import signals as signal_streaming
from tests.conftest import CONTRACTS, PRODUCTS, RUN_AT, write_file

QUERIES = [
    ("turned", "p2723 dell"), ("layout", "vjybnjh dell 27"), ("brand", "шина nordx 195"), ("vowel", "канфеты шоколадные"),
    ("alias", "покрышка nordex ice 205"), ("tyres", "шина nordex"), ("none", "!!!"),
]


@pytest.fixture(scope="module")
def understood(spark, tables):
    queries = spark.createDataFrame(QUERIES, "query_id string, query string").withColumn(
        "customer_inn", F.lit("40")
    ).withColumn("session_id", F.lit("s1"))
    from quarry.session import materialize

    return materialize(
        understanding.understand_queries(queries, tables.dictionary, tables.rules), "test-queries"
    )


@pytest.fixture(scope="module")
def ranked(understood, tables, overlay):
    rows = search_plan.rank(understood, tables, overlay).orderBy("query_id", "rank").collect()
    return {q: [r for r in rows if r.query_id == q] for q, _ in QUERIES}


def test_full_load(spark, snapshot):
    folder, run = snapshot
    counts = {r.metric: r.value for r in store.summarize(spark, folder).collect()}
    assert counts == {"products": 7, "contracts": 8, "profiles": 4, "demo_profiles": 3}
    assert run.status == "successful" and run.warnings == []
    assert run.stats["matched_contracts"] == 7 and run.stats["unmatched_contracts"] == 1


def test_future_contract_gives_no_last_purchase(spark, snapshot):
    profile = store.read_table(spark, snapshot[0], "profiles").filter("customer_inn = '67'").first()
    assert profile.last_purchase_at is None and profile.purchase_count == 1


def test_top_results(ranked):
    tops = {q: rows[0].ste_id for q, rows in ranked.items() if rows}
    assert tops == {
        "turned": "M27", "layout": "M27", "brand": "T61", "vowel": "K10", "alias": "T58", "tyres": "T61",
    }
    assert ranked["none"] == []


def test_interpretation(understood):
    rows = {r.query_id: r for r in understood.collect()}
    assert rows["layout"].corrected_query.startswith("монитор")
    assert rows["layout"].layout_mappings[0].asDict() == {"from": "vjybnjh", "to": "монитор", "keyboard": "en_to_ru"}
    assert "27" in rows["layout"].protected_tokens
    assert rows["brand"].corrected_tokens[1] == "nordex"
    assert rows["brand"].typo_mappings[0]["to"] == "nordex" and rows["brand"].spell_candidates
    assert rows["vowel"].corrected_query.startswith("конфеты")
    assert rows["alias"].applied_synonyms and "шины" in rows["alias"].retrieval_tokens


def test_known_word_is_not_corrected(spark):
    dictionary = spark.createDataFrame(
        [("бакалея", "бакалея", 150, "token", 1), ("рабочая", "рабочий", 200, "token", 1)],
        "term string, lemma string, doc_freq int, term_type string, source_mask int",
    )
    rules = spark.createDataFrame([], "alias string, canonical string, scope string, source string, status string")
    known = spark.createDataFrame([("батарея",)], "word string")
    queries = spark.createDataFrame([("1", "батарея"), ("2", "ребочая")], "query_id string, query string")
    rows = {r.query_id: r for r in understanding.understand_queries(queries, dictionary, rules, known).collect()}
    assert rows["1"].corrected_tokens == ["батарея"] and not rows["1"].typo_mappings
    assert rows["2"].corrected_tokens == ["рабочая"]


def test_personalised_score_is_not_below_baseline(understood, tables, ranked):
    base = {
        (r.query_id, r.ste_id): r.score for r in search_plan.rank(understood, tables).collect()
    }
    assert ranked["turned"][0].score > base["turned", "M27"]
    assert set(base) == {(r.query_id, r.ste_id) for rows in ranked.values() for r in rows}


def test_negative_event_lowers_the_product(spark, understood, tables, ranked):
    events = spark.createDataFrame(
        [("e1", "s1", "40", "marked_irrelevant", "T61", datetime(2025, 6, 1))],
        "event_id string, session_id string, customer_inn string, event_type string, ste_id string, created_at timestamp",
    )
    by_product, by_category = signals.session_signals(signals.enrich_events(events, tables.products))
    overlay = Overlay(session_products=by_product, session_categories=by_category)
    after = search_plan.rank(understood, tables, overlay).filter("query_id = 'tyres'").collect()
    before = ranked["tyres"][0]
    assert all(r.ste_id != before.ste_id or r.score < before.score for r in after)


def test_explanation_and_facets(ranked, understood, tables, overlay):
    results = search_plan.rank(understood, tables, overlay)
    page = ranking.page(results, 5)
    explained = search_plan.explain(page, understood, tables, overlay).filter("query_id = 'turned'").first()
    assert explained.explanation.startswith("Совпадение в полнотекстовом индексе; ")
    assert {f.type for f in explained.factors} >= {"lexical", "token_overlap", "history_product"}
    total = sum(explained[f] for f in
                ["f_lexical", "f_phrase", "f_title", "f_category", "f_attributes", "f_numbers",
                 "f_history_product", "f_history_category", "f_history_tokens", "s_product", "s_category"])
    assert explained.score == pytest.approx(total, abs=1e-6)
    counted = facets.facets(search_plan.describe(page, tables)).filter("query_id = 'tyres'").collect()
    assert any(r.facet == "category" and r.value == "Шины" for r in counted)


def test_filters(spark, understood, tables):
    wanted = spark.createDataFrame(
        [("tyres", "attributes", "Сезон::зима"), ("tyres", "attributes", " Ширина::205 мм "),
         ("turned", "brands", "Lenovo"), ("vowel", "categories", "Сладости")],
        "query_id string, kind string, value string",
    )
    rows = search_plan.rank(understood, tables, filters=wanted).collect()
    assert {r.ste_id for r in rows if r.query_id == "tyres"} == {"T58"}
    assert not [r for r in rows if r.query_id == "turned"]
    assert {r.ste_id for r in rows if r.query_id == "vowel"} >= {"K10"}


def test_feed(spark, snapshot, tables, overlay):
    contracts = store.read_table(spark, snapshot[0], "contracts")
    customers = spark.createDataFrame([("31",), (K.NEW_CUSTOMER,)], "customer_inn string")
    rows = recommend_plan.recommend(customers, tables.products, contracts, overlay).orderBy("rank").collect()
    own = [r for r in rows if r.customer_inn == "31"]
    fresh = [r for r in rows if r.customer_inn == K.NEW_CUSTOMER]
    assert own[0].ste_id in {"K10", "K12"} and own[0].feed_source == "personalized_feed"
    assert len({r.ste_id for r in own}) == len(own)
    assert fresh and all(r.bucket == "popular" and r.feed_source == "cold_start_feed" for r in fresh)
    explained = feed.explain_feed(
        recommend_plan.recommend(customers, tables.products, contracts, overlay)
    ).filter("rank = 1").collect()
    assert all(r.explanation for r in explained)


def test_incremental_loads_equal_full_load(spark, snapshot, tmp_path):
    later = RUN_AT + timedelta(days=1)
    lamp = 'L05;Лампа настольная Свет 5 Вт;Лампы;"Мощность:5 Вт;Цвет:белый"\n'
    bought = (
        "Лампа настольная Свет 5 Вт;D-990;L05;2025-05-30 12:00:00;950;88;Покупатель 88;Омск;77990;Склад 0;Пермь\n"
        "Лампа;D-991;L05;2025-05-31 12:00:00;дорого;40;Покупатель 40;Омск;77991;Склад 1;Пермь\n"
    )
    step = str(tmp_path / "step")
    run = store.refresh(
        spark, step, "upsert_bundle", later, previous=snapshot[0],
        products_path=write_file(tmp_path, "p.csv", lamp),
        contracts_path=write_file(tmp_path, "c.csv", bought),
    ).first()
    assert run.stats["products_upserted"] == 1 and run.stats["contracts_upserted"] == 2
    assert run.warnings == ["contracts: invalid cost"] and run.stats["customers_rebuilt"] == 2
    whole = str(tmp_path / "whole")
    store.refresh(
        spark, whole, "replace_all", later,
        products_path=write_file(tmp_path, "all_p.csv", PRODUCTS + lamp),
        contracts_path=write_file(tmp_path, "all_c.csv", CONTRACTS + bought),
    )

    def content(folder, name, *columns):
        return sorted(map(str, store.read_table(spark, folder, name).select(*columns).collect()))

    asked = spark.createDataFrame(
        [("a", ["лампа", "белый"]), ("b", ["шина"]), ("c", ["ice", "dell"])], "query_id string, retrieval_tokens array<string>"
    )
    for name, columns in {
        "dictionary": ["term", "lemma", "doc_freq", "term_type", "source_mask"],
        "products": ["ste_id", "title_raw", "search_text"],
        "contracts": ["contract_key", "cost", "matched_product"],
    }.items():
        assert content(step, name, *columns) == content(whole, name, *columns)
    found = [
        sorted(map(str, index.retrieve(asked, search_plan.load_search_tables(spark, folder).index, 20).collect())) for folder in (step, whole)
    ]
    assert found[0] == found[1] and any("L05" in r for r in found[0])
    new = store.read_table(spark, step, "profiles").filter("customer_inn = '88'").first()
    assert new.purchase_count == 1 and new.matched_purchase_count == 1


def test_product_load_rematches_and_rebuilds_profiles(spark, snapshot, tmp_path):
    missing = 'Z00;Снятый товар;Прочее;"Цвет:синий"\nK12;Новое имя;Сладости;"A:b"\n'
    target = str(tmp_path / "t")
    store.refresh(
        spark, target, "upsert_ste", RUN_AT + timedelta(days=1), previous=snapshot[0],
        products_path=write_file(tmp_path, "p.csv", missing),
    )
    assert store.read_table(spark, target, "contracts").filter("ste_id = 'Z00'").first().matched_product
    profile = store.read_table(spark, target, "profiles").filter("customer_inn = '52'").first()
    assert profile.matched_purchase_count == 1
    renamed = store.read_table(spark, target, "products").filter("ste_id = 'K12'").first()
    assert renamed.title_raw == "Новое имя" and renamed.created_at == RUN_AT
    attributes = catalog.product_attributes(store.read_table(spark, target, "products"))
    assert [r.name_raw for r in attributes.filter("ste_id = 'K12'").collect()] == ["A"]


def test_publishing_shows_finished_runs_only(spark, tmp_path):
    root, day = str(tmp_path / "root"), iter(datetime(2025, 7, 1) + timedelta(minutes=i) for i in range(20))
    clock = lambda: next(day)
    assert store.published(spark, root) is None
    goods, bought = write_file(tmp_path, "p.csv", PRODUCTS), write_file(tmp_path, "c.csv", CONTRACTS)
    first = store.publish(spark, root, "replace_all", RUN_AT, goods, bought, clock).first()
    with pytest.raises(Exception):  # noqa: B017
        store.publish(spark, root, "upsert_ste", RUN_AT, str(tmp_path / "absent.csv"), clock=clock)
    assert store.published(spark, root) == first.folder
    assert store.summarize(spark, store.published(spark, root)).filter("metric = 'products'").first().value == 7
    more = write_file(tmp_path, "q.csv", 'L05;Лампа;Лампы;"Мощность:5 Вт"\n')
    second = store.publish(spark, root, "upsert_ste", RUN_AT + timedelta(days=1), more, clock=clock).first()
    assert store.published(spark, root) == second.folder and second.started_at < second.finished_at
    runs = store.recent_runs(spark, root).collect()
    assert [r.status for r in runs] == ["successful", "failed", "successful"] and runs[1].error and not runs[1].stats


def test_modes_are_checked(spark, tmp_path):
    with pytest.raises(ValueError):
        store.refresh(spark, str(tmp_path), "unknown", RUN_AT)
    with pytest.raises(ValueError):
        store.refresh(spark, str(tmp_path), "replace_all", RUN_AT, products_path="x")


def test_headers_delimiters_and_quarantine(spark, tmp_path):
    commas = (
        "Идентификатор СТЕ,Наименование СТЕ,Категория,Атрибуты\n"
        '9001,"Товар, ""лучший""",Категория,"Цвет:синий\nРазмер:1"\n'
        "\n9002,Без категории,,x\n9003,три,поля\n9004,a,b,c,d\n"
    )
    path = write_file(tmp_path, "products.csv", commas)
    assert files.sniff_layout(spark, path, "products") == (",", True)
    good, bad = files.read_products(spark, path)
    assert [r.title for r in good.collect()] == ['Товар, "лучший"']
    assert sorted(r.reason for r in bad.collect()) == [
        "required field is empty", "wrong number of columns", "wrong number of columns",
    ]
    write_file(tmp_path, "c.csv", CONTRACTS)
    write_file(tmp_path, "d.csv", PRODUCTS)
    found = files.discover_inputs(spark, str(tmp_path))
    assert found["contracts"].endswith("c.csv") and found["products"].endswith("d.csv")


def test_files_of_a_folder_keep_their_own_layout_and_order(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    write_file(folder, "a.csv", "Идентификатор СТЕ;Наименование СТЕ;Категория;Атрибуты\n71;Старый;Стол;x:1\n72;Первый;Стол;x:1\n2;Категория;Атрибуты;x:1\n")
    write_file(folder, "b.csv", "".join(f"{900 + i};Стул {i};Стулья;x:1\n" for i in range(60)) + "71;Новый;Стол;x:1\n72;Второй;Стол;x:1\n72;Третий;Стол;x:1\n")
    write_file(folder, "c.csv", '81,"Лампа, синяя",Лампы,"цвет:синий"\n71,Последний,Стол,x:1\n')
    good, bad = files.read_products(spark, str(folder))
    loaded = {r.ste_id: r.title_raw for r in store.load_products(spark, None, good, RUN_AT).collect()}
    assert loaded["71"] == "Последний" and loaded["72"] == "Третий" and loaded["81"] == "Лампа, синяя"
    assert loaded["2"] == "Категория" and len(loaded) == 64 and bad.isEmpty()
    landing = str(tmp_path / "landing")
    ingest_streaming.ingest_stream(spark, str(folder), "products", landing).trigger(availableNow=True).start().awaitTermination()
    streamed = {r.ste_id: r.title_raw for r in ingest_streaming.current_rows(spark, landing, "products").collect()}
    assert streamed == loaded


@pytest.mark.parametrize("block", [150, 1 << 20])
def test_quoted_records_are_read_by_blocks(spark, tmp_path, block):
    """As Python's csv reads them, however a file is cut into blocks."""
    import csv
    import io

    cells = [
        ["1", "Труба 5\" стальная", "Трубы", "a:1"], ["2", "две\nстроки", "К", "x:1;y:2"], ["3", "\"в кавычках\"", "К", "\n\n"],
        ["4", "без", "К", "\"\";\n;\"\""], ["5", "длинный" * 30, "К", "z\n" * 20], ["6", "конец", "К", "\"\n\""],
    ]
    out = io.StringIO()
    for i, row in enumerate(cells * 6):
        if "\n" in "".join(row) or ";" in "".join(row) or row[1].startswith('"'):
            csv.writer(out, delimiter=";", lineterminator="\n", quoting=csv.QUOTE_MINIMAL if i % 2 else csv.QUOTE_ALL).writerow(row)
        else:
            out.write(";".join(row) + "\n")
    folder = tmp_path / "in"
    folder.mkdir()
    write_file(folder, "a.csv", out.getvalue())
    write_file(folder, "b.csv", "7;простая;К;x:1\n\n8;Доска 2\" и 3\";К;x:1\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(block))
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        rows = files.read_delimited(spark, str(folder), "products").orderBy(files.PLACE).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    want = [r for text in (out.getvalue(), "7;простая;К;x:1\n8;Доска 2\" и 3\";К;x:1\n") for r in csv.reader(io.StringIO(text), delimiter=";")]
    assert [[r[c] or "" for c in files.PRODUCT_COLUMNS] for r in rows] == want
    assert all(r[files.CORRUPT] is None for r in rows)


def test_events_sink_run_log_clear_and_exports(spark, snapshot, tables, tmp_path):
    folder = str(tmp_path)
    events = spark.createDataFrame(
        [("e1", "s", "31", "result_saved", "W90", datetime(2025, 6, 1)),
         ("e2", "s", "31", "unknown_type", "W90", datetime(2025, 6, 1)),
         ("e3", "s", "31", "search_submitted", None, datetime(2025, 6, 1))],
        "event_id string, session_id string, customer_inn string, event_type string, ste_id string, created_at timestamp",
    )
    store.append_events(events, tables.products, folder)
    store.append_events(events.filter("event_id = 'e3'"), tables.products, folder)
    assert store.read_table(spark, folder, "events").count() == 3
    saved = catalog.saved_results(store.read_table(spark, folder, "saved_results"), tables.products).collect()
    assert [r.title_raw for r in saved] == ["Планшет Lenovo Tab M10"]
    run = spark.createDataFrame([("a", datetime(2025, 1, 1)), ("b", datetime(2025, 1, 2))], "run_id string, finished_at timestamp")
    store.append_run_log(run, folder)
    assert [r.run_id for r in store.recent_runs(spark, folder, 1).collect()] == ["b"]
    store.clear(spark, snapshot[0], f"{folder}/cleared", ["products", "contracts"])
    assert store.read_table(spark, f"{folder}/cleared", "products").isEmpty()
    store.export_dictionary(tables.dictionary, f"{folder}/json", "json")
    assert spark.read.json(f"{folder}/json").count() == tables.dictionary.count()
    store.export_synonyms(store.read_table(spark, snapshot[0], "synonym_candidates"), f"{folder}/synonyms")


def test_signal_stream_equals_batch(spark, tables, tmp_path):
    rows = [
        (i, f"s{i % 3}", ["result_opened", "result_saved", "marked_irrelevant"][i % 3 if i % 7 else 1],
         ["T61", "W90"][i % 2], datetime(2025, 6, 1) + timedelta(seconds=i * 37 % 1000))
        for i in range(900)
    ]
    events = spark.createDataFrame(
        rows, "event_id long, session_id string, event_type string, ste_id string, created_at timestamp"
    ).withColumn("customer_inn", F.lit("1"))
    enriched = signals.enrich_events(events, tables.products)
    source = str(tmp_path / "in")
    enriched.unionByName(enriched.filter("event_id < 50")).repartition(5).write.parquet(source)
    stream = spark.readStream.schema(enriched.schema).option("maxFilesPerTrigger", 2).parquet(source)
    out = str(tmp_path / "out")
    writer = signal_streaming.write_signals(signal_streaming.session_signals_stream(stream), out)
    writer.option("checkpointLocation", str(tmp_path / "progress")).trigger(availableNow=True).start().awaitTermination()
    live = signal_streaming.latest_signals(spark.read.parquet(out)).filter("kind = 'product'")
    by_product, _ = signals.session_signals(enriched)
    expected = {(r.session_id, r.ste_id): round(r.weight, 6) for r in by_product.collect()}
    assert {(r.session_id, r.key): round(r.weight, 6) for r in live.collect()} == expected


def test_live_signals_end_and_are_merged(spark, tables, tmp_path):
    """Repeated events count once, late ones and silent sessions go, one that comes back starts anew."""
    begin, minute = datetime(2025, 6, 1), timedelta(minutes=1)
    rows = [
        [("a", 1, 0), ("a", 2, 1), ("b", 3, 1)], [("a", 2, 1), ("a", 1, 0), ("c", 4, 5)],  # both events of a once more
        [("c", 5, 200)], [("c", 6, 201), ("d", 7, 3)],  # d is later than the watermark allows
        [("b", 8, 202)], [("c", 9, 203)],
    ]
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    schema = "event_id long, session_id string, event_type string, ste_id string, category_norm string, created_at timestamp"
    for i, batch in enumerate(rows):
        events = [(n, s, "result_saved", "T61", "шины", begin + at * minute) for s, n, at in batch]
        spark.createDataFrame(events, schema).coalesce(1).write.parquet(f"{source}/{i}")
        stream = spark.readStream.schema(schema).parquet(f"{source}/*")
        signals_ = signal_streaming.session_signals_stream(stream, "10 minutes", timedelta(minutes=30))
        writer = signal_streaming.write_merged_signals(signals_, out, every=2)
        writer.option("checkpointLocation", str(tmp_path / "progress")).trigger(availableNow=True).start().awaitTermination()
        if i == 1:
            live = {(r.session_id, r.kind): r.weight for r in signal_streaming.current_signals(spark, out).collect()}
            assert live["a", "product"] == 2 * live["b", "product"] == 2 * live["c", "product"]
    live = {(r.session_id, r.kind): r.weight for r in signal_streaming.current_signals(spark, out).collect()}
    assert {s for s, _ in live} == {"b", "c"}  # a was silent, b came back with one event, c never fell silent
    assert live["b", "product"] * 4 == pytest.approx(live["c", "product"])
    assert len(list((tmp_path / "out" / "merged").glob("n=*"))) == 1 and len(list((tmp_path / "out" / "changes").glob("n=*"))) < 2


def test_event_stream_saves_products(spark, tables, tmp_path):
    schema = "event_id string, session_id string, customer_inn string, event_type string, ste_id string, created_at timestamp"
    events = [("e1", "s", "31", "result_saved", "W90", RUN_AT), ("e2", "s", "31", "no_such_type", "W90", RUN_AT), ("e3", "s", "31", "result_opened", "T61", RUN_AT)]
    spark.createDataFrame(events, schema).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    writer = signal_streaming.write_events(stream, tables.products, str(tmp_path / "out"))
    writer.option("checkpointLocation", str(tmp_path / "progress")).trigger(availableNow=True).start().awaitTermination()
    written = spark.read.parquet(str(tmp_path / "out" / "events"))
    assert {(r.event_id, r.category_norm) for r in written.collect()} == {("e1", "планшеты"), ("e3", "шины")}
    assert [r.ste_id for r in spark.read.parquet(str(tmp_path / "out" / "saved_results")).collect()] == ["W90"]


def test_ingest_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    write_file(tmp_path / "in", "1.csv", PRODUCTS)
    landing = str(tmp_path / "landing")

    def load():
        ingest_streaming.ingest_stream(spark, str(tmp_path / "in"), "products", landing).trigger(
            availableNow=True
        ).start().awaitTermination()
        return ingest_streaming.current_rows(spark, landing, "products")

    assert load().count() == 7
    write_file(tmp_path / "in", "2.csv", 'K12;"Новое\n""тёплое"" имя";Сладости;"A:b"\nплохо;строка\n')
    rows = {r.ste_id: r.title_raw for r in load().collect()}
    assert len(rows) == 7 and rows["K12"] == 'Новое "тёплое" имя'
    assert spark.read.parquet(f"{landing}/quarantine_products").count() == 1


def test_contains_search_and_lookup(spark, tables):
    products = tables.products.withColumn("plain_text", F.lower("title_raw")).withColumn(
        "attributes_raw", F.col("attributes_raw")
    )
    queries = spark.createDataFrame(
        [("1", " NORDEX "), ("2", "r16"), ("3", "нет такого"), ("4", ""), ("5", "р")],
        "query_id string, query string",
    )
    rows = catalog.contains_search(products, queries, limit=1).collect()
    assert {(r.query_id, r.ste_id, r.total_count) for r in rows} == {
        ("1", "T58", 2), ("2", "T58", 1), ("5", "K10", 6),
    }
    ids = spark.createDataFrame([("W90",), ("W90",)], "ste_id string")
    found = catalog.lookup_products(tables.products, ids).collect()
    assert [r.brand_guess for r in found] == ["Lenovo"] and len(found[0].attributes) == 2


def test_rank_shift(spark):
    schema = "query_id string, ste_id string, rank int"
    before = spark.createDataFrame([("q", "a", 1), ("q", "b", 2)], schema)
    after = spark.createDataFrame([("q", "b", 1), ("q", "c", 2)], schema)
    rows = {r.ste_id: (r.before, r.after, r.delta) for r in ranking.rank_shift(before, after).collect()}
    assert rows == {"b": (2, 1, 1), "c": (None, 2, None)}
