"""The maintained tables: load modes, snapshots, run log, exports, event sink.

A refresh reads one folder of Parquet tables and writes a new one, so readers of the old
snapshot are never disturbed and a lost executor only repeats its own tasks. Events, saved
products and the run log are append-only tables in folders of their own.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from datetime import datetime

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quarry.operators import catalog, profiles, scoring, signals, vocabulary
from quarry.session import materialize
from quarry.sources import files, index_store

MODES = {
    "replace_all": ("products", "contracts"),
    "upsert_ste": ("products",),
    "append_contracts": ("contracts",),
    "upsert_bundle": ("products", "contracts"),
}
PROFILE_TABLES = ["profiles", "product_weights", "category_weights", "token_weights"]
MAX_WARNINGS = 200


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}")


def write_table(df: DataFrame, folder: str, name: str) -> DataFrame:
    path = f"{folder}/{name}"
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def new_rows(rows: DataFrame, key: str, run_at: datetime) -> DataFrame:
    """Rows of one load with their time stamps; of rows with one key the last, by file and place in it.

    Rows that were not read from files have no place; theirs is the order of the table's partitions.
    """
    stamped = rows.withColumns({"created_at": F.lit(run_at), "updated_at": F.lit(run_at)})
    if files.PLACE not in rows.columns:
        stamped = stamped.withColumn(files.PLACE, F.monotonically_increasing_id())
    return catalog.latest_per_key(stamped, key, F.col(files.PLACE), []).drop(files.PLACE)


def load_products(
    spark: SparkSession, previous: str | None, delta: DataFrame | None, run_at: datetime
) -> DataFrame:
    """Product rows after a load: new ones replace old ones, ``created_at`` stays."""
    fresh = None
    if delta is not None:
        fresh = new_rows(catalog.standardize_products(delta), "ste_id", run_at)
    if previous is None:
        return fresh
    base = read_table(spark, previous, "catalog")
    if fresh is None:
        return base
    return catalog.upsert(base, fresh, "ste_id", "updated_at", ["created_at"])


def load_contracts(
    spark: SparkSession, previous: str | None, delta: DataFrame | None, run_at: datetime
) -> DataFrame:
    """Contract rows after a load; the customer of a known contract is not changed."""
    fresh = None
    if delta is not None:
        typed = catalog.standardize_contracts(delta)
        fresh = new_rows(typed, "contract_key", run_at)
    if previous is None:
        return fresh
    base = read_table(spark, previous, "contracts").drop("matched_product")
    if fresh is None:
        return base
    return catalog.upsert(
        base, fresh, "contract_key", "updated_at", ["customer_inn", "created_at"]
    )


def changed_customers(
    before: DataFrame | None, after: DataFrame, products: DataFrame, run_at: datetime
) -> DataFrame:
    """Customers with a new or changed contract, or one whose product is new or changed."""
    own = after.filter(F.col("updated_at") == F.lit(run_at)).select("customer_inn")
    loaded = products.filter(F.col("updated_at") == F.lit(run_at)).select("ste_id")
    through_products = after.join(loaded, "ste_id", "left_semi").select("customer_inn")
    touched = own.unionByName(through_products)
    if before is None:
        touched = after.select("customer_inn")
    return touched.distinct()


def build_profiles(
    contracts: DataFrame, products: DataFrame, as_of: datetime, counts: DataFrame | None = None,
    write: Callable[[DataFrame, str], DataFrame] = materialize,
) -> dict[str, DataFrame]:
    """The four profile tables of the given contracts; weights that others are made from are written once.

    ``counts`` are given where another catalogue decides what is matched; ``write`` puts a table where it stays.
    """
    if counts is None:
        counts = profiles.purchase_counts(contracts, as_of)
    by_product = write(profiles.customer_product_weights(contracts, as_of), "product_weights")
    by_category = write(profiles.customer_category_weights(by_product, products), "category_weights")
    by_token = write(profiles.customer_token_weights(contracts, by_product, products, as_of), "token_weights")
    return {
        "profiles": write(profiles.customer_profiles(counts, by_category, by_product, by_token), "profiles"),
        "product_weights": by_product,
        "category_weights": by_category,
        "token_weights": by_token,
    }


def refresh(
    spark: SparkSession,
    target: str,
    mode: str,
    run_at: datetime,
    previous: str | None = None,
    products_path: str | None = None,
    contracts_path: str | None = None,
) -> DataFrame:
    """Load files in one of the four modes into a new snapshot; returns its run-log row."""
    if mode not in MODES:
        raise ValueError(f"unsupported mode {mode!r}")
    paths = {"products": products_path, "contracts": contracts_path}
    missing = [kind for kind in MODES[mode] if not paths[kind]]
    if missing:
        raise ValueError(f"{mode} requires {' and '.join(missing)}")
    if target == previous:
        raise ValueError("a refresh writes a new folder, not the snapshot that it reads")
    base = None if mode == "replace_all" else previous
    if mode != "replace_all" and base is None:
        raise ValueError(f"{mode} needs a previous snapshot")

    deltas: dict[str, DataFrame | None] = {"products": None, "contracts": None}
    warnings = []
    for kind in MODES[mode]:
        good, quarantine = files.validate_rows(files.read_delimited(spark, paths[kind], kind), kind)
        deltas[kind] = good
        write_table(quarantine, target, f"quarantine_{kind}")
        warnings.append(
            read_table(spark, target, f"quarantine_{kind}").select(
                F.concat_ws(": ", F.lit(kind), "reason").alias("warning")
            )
        )

    products = write_table(
        load_products(spark, base, deltas["products"], run_at), target, "catalog"
    )
    contracts = write_table(
        catalog.flag_matched(load_contracts(spark, base, deltas["contracts"], run_at), products),
        target, "contracts",
    )
    before = read_table(spark, base, "contracts") if base else None
    touched = write_table(
        changed_customers(before, contracts, products, run_at), target, "touched_customers"
    )
    if base:
        rebuilt = build_profiles(contracts.join(touched, "customer_inn", "left_semi"), products, run_at)
        for name, df in rebuilt.items():
            write_table(profiles.refresh_profiles(read_table(spark, base, name), touched, df), target, name)
    else:
        build_profiles(contracts, products, run_at, write=lambda df, name: write_table(df, target, name))
    write_table(
        profiles.showcase_profiles(
            read_table(spark, target, "profiles"), read_table(spark, target, "category_weights")
        ),
        target, "showcase",
    )
    build_vocabulary(spark, products, contracts, target, base)
    stats = write_table(load_stats(spark, target, run_at, MODES[mode]), target, "stats")
    return run_row(spark, mode, run_at, warnings, stats)


def build_vocabulary(
    spark: SparkSession, products: DataFrame, contracts: DataFrame, target: str, base: str | None = None
) -> None:
    """Dictionary, synonyms, search text, lexicon and index of a snapshot; the index goes on from that of ``base``."""
    seeds = vocabulary.seed_synonyms(spark)
    dictionary = write_table(
        vocabulary.term_dictionary(products, contracts, seeds), target, "dictionary"
    )
    candidates = write_table(
        vocabulary.synonym_candidates(dictionary, seeds), target, "synonym_candidates"
    )
    rules = write_table(
        vocabulary.synonym_rules(candidates, dictionary, seeds), target, "synonym_rules"
    )
    full = scoring.with_match_columns(vocabulary.with_search_text(products, rules))
    full = write_table(full, target, "products")
    write_table(vocabulary.lexicon(full), target, "lexicon")
    if base:
        index_store.update_index(spark, base, target, read_table(spark, base, "products"), full, "ste_id", "search_text")
    else:
        index_store.write_index(spark, target, full, "ste_id", "search_text")
    searched = catalog.searched_fields(catalog.with_plain_text(full))
    index_store.write_pieces(spark, target, searched, "ste_id", ["plain_text", "raw"])


def load_stats(
    spark: SparkSession, target: str, run_at: datetime, loaded: tuple[str, ...]
) -> DataFrame:
    """What a run did, one (metric, value) row each."""
    products = read_table(spark, target, "products")
    contracts = read_table(spark, target, "contracts")
    now = F.col("updated_at") == F.lit(run_at)
    new_products = products.filter(now if "products" in loaded else F.lit(False))
    new_contracts = contracts.filter(now if "contracts" in loaded else F.lit(False))
    measured = {
        "products_upserted": new_products,
        "attributes_upserted": catalog.product_attributes(new_products),
        "contracts_upserted": new_contracts,
        "matched_contracts": new_contracts.filter("matched_product"),
        "unmatched_contracts": new_contracts.filter("not matched_product"),
        "customers_rebuilt": read_table(spark, target, "touched_customers"),
        "demo_profiles": read_table(spark, target, "showcase"),
        "lexicon_terms": vocabulary.term_counts(products),
        "dictionary_terms": read_table(spark, target, "dictionary"),
        "synonym_candidates": read_table(spark, target, "synonym_candidates"),
        "synonym_rules": read_table(spark, target, "synonym_rules"),
    }
    return count_rows(measured)


def count_rows(tables: dict[str, DataFrame]) -> DataFrame:
    """One (metric, value) row per table with its number of rows."""
    rows = None
    for name, df in tables.items():
        row = df.agg(F.count("*").alias("value")).select(F.lit(name).alias("metric"), "value")
        rows = row if rows is None else rows.unionByName(row)
    return rows


def summarize(spark: SparkSession, folder: str) -> DataFrame:
    """Row counts of the main tables of a snapshot."""
    names = {
        "products": "products", "contracts": "contracts", "profiles": "profiles",
        "demo_profiles": "showcase",
    }
    return count_rows({k: read_table(spark, folder, v) for k, v in names.items()})


def run_row(
    spark: SparkSession, mode: str, run_at: datetime, warnings: list[DataFrame], stats: DataFrame
) -> DataFrame:
    """Run-log row of a finished load; at most 200 warnings are listed."""
    listed = warnings[0]
    for more in warnings[1:]:
        listed = listed.unionByName(more)
    shown = listed.limit(MAX_WARNINGS).agg(F.collect_list("warning").alias("warnings"))
    values = stats.agg(
        F.map_from_entries(F.collect_list(F.struct("metric", "value"))).alias("stats")
    )
    return shown.select(
        F.concat_ws("-", F.lit(mode), F.lit(run_at.strftime("%Y%m%dT%H%M%S"))).alias("run_id"),
        F.lit(mode).alias("mode"),
        F.lit("successful").alias("status"),
        F.lit(run_at).alias("finished_at"),
        "warnings",
        values.select("stats").scalar().alias("stats"),
    )


RUN_SCHEMA = (
    "run_id string, mode string, status string, started_at timestamp, finished_at timestamp, folder string, "
    "error string, warnings array<string>, stats map<string,bigint>"
)


def append_run_log(run: DataFrame, folder: str) -> None:
    run.write.mode("append").parquet(f"{folder}/runs")


def recent_runs(spark: SparkSession, folder: str, n: int = 10) -> DataFrame:
    return read_table(spark, folder, "runs").orderBy(F.desc("finished_at"), "run_id").limit(n)


def published(spark: SparkSession, root: str) -> str | None:
    """Folder of the newest snapshot below ``root`` that a run has finished, by the run log alone."""
    try:
        runs = read_table(spark, root, "runs")
    except AnalysisException:
        return None
    found = runs.filter("status = 'successful'").agg(F.max_by("folder", F.struct("finished_at", "run_id")).alias("folder")).first()
    return found.folder


def publish(
    spark: SparkSession,
    root: str,
    mode: str,
    run_at: datetime,
    products_path: str | None = None,
    contracts_path: str | None = None,
    clock: Callable[[], datetime] = datetime.now,
) -> DataFrame:
    """Refresh into a new folder below ``root`` and enter the run into its log, as its last step.

    Readers ask ``published`` for the newest finished snapshot, so they never see tables of a run that failed or is
    under way. A failed run is entered with its error and raised; its folder is named nowhere else.
    """
    started, run_id = clock(), f"{mode}-{run_at:%Y%m%dT%H%M%S}-{uuid.uuid4().hex[:8]}"
    target, previous = f"{root}/{run_id}", published(spark, root)
    row = {"run_id": F.lit(run_id), "mode": F.lit(mode), "started_at": F.lit(started), "folder": F.lit(target)}
    try:
        done = refresh(spark, target, mode, run_at, previous, products_path, contracts_path)
        done = done.withColumns(row | {"finished_at": F.lit(clock()), "error": F.lit(None).cast("string")})
        logged = materialize(done.select(*[f.name for f in StructType.fromDDL(RUN_SCHEMA)]), "run")
    except Exception as error:
        failed = spark.createDataFrame(
            [(run_id, mode, "failed", started, clock(), target, f"{type(error).__name__}: {error}"[:2000], [], {})], RUN_SCHEMA
        )
        append_run_log(failed, root)
        raise
    append_run_log(logged, root)
    return logged


def clear(spark: SparkSession, previous: str, target: str, names: list[str]) -> None:
    """A snapshot with the given tables empty."""
    for name in names:
        write_table(read_table(spark, previous, name).limit(0), target, name)


def append_events(events: DataFrame, products: DataFrame, folder: str) -> None:
    """Append the valid events with their category, and the saved products among them."""
    enriched = signals.enrich_events(events, products)
    enriched.write.mode("append").parquet(f"{folder}/events")
    signals.saved_from_events(enriched).write.mode("append").parquet(f"{folder}/saved_results")


def dictionary_lines(dictionary: DataFrame) -> DataFrame:
    """``term frequency`` lines, most frequent first; sorted by range, not in one task."""
    ordered = dictionary.orderBy(F.desc("doc_freq"), "term")
    return ordered.select(F.concat_ws(" ", "term", F.col("doc_freq").cast("string")).alias("value"))


def export_dictionary(dictionary: DataFrame, path: str, form: str = "text") -> None:
    """Dictionary as frequency lines (``text``) or as one JSON object per term (``json``)."""
    if form == "text":
        dictionary_lines(dictionary).write.mode("overwrite").text(path)
    elif form == "json":
        dictionary.orderBy("term").write.mode("overwrite").json(path)
    else:
        raise ValueError(f"unknown form {form!r}")


def export_synonyms(candidates: DataFrame, path: str) -> None:
    candidates.orderBy(F.desc("score"), "alias", "canonical").write.mode("overwrite").json(path)
