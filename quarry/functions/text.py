"""Text expressions: cleaning, normalising, tokenising, stemming, typing.

Each takes and returns Columns and stays inside the JVM. Expressions that work on normalised
text say so; apply ``normalize`` once and reuse the column.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quarry.functions import constants as K


def clean(cell: Column) -> Column:
    """Cell text without byte-order marks, outer quotes and runs of whitespace; never null."""
    bare = F.regexp_replace(F.coalesce(cell, F.lit("")), r"[\x{FEFF}\x{200B}]", "")
    spaced = F.btrim(F.regexp_replace(bare, r"(?U)\s+", " "))
    return F.btrim(F.btrim(spaced, F.lit('"')))


def normalize(cell: Column) -> Column:
    """Lower-case search form: unified dashes and quotes, decimal dots, spaced sizes and units."""
    text = F.replace(clean(cell), F.lit("№"), F.lit(" n "))
    text = F.lower(F.translate(text, "ёЁ—–−×«»", 'ее---x""'))
    text = F.regexp_replace(text, r"(?<=\d),(?=\d)", ".")
    text = F.regexp_replace(text, r"(?<=\d)\s*[xх]\s*(?=\d)", " x ")
    text = F.regexp_replace(text, rf"(?U)(?<=\d)([{K.LETTERS}%]+)\b", " $1")
    return F.btrim(F.regexp_replace(text, r"(?U)\s+", " "))


def tokens(normalized: Column) -> Column:
    """Distinct tokens of normalised text in reading order; a compound is followed by its parts."""
    found = F.regexp_extract_all(normalized, F.lit(f"({K.TOKEN_PATTERN})"), F.lit(1))
    with_parts = F.flatten(
        F.transform(
            found,
            lambda t: F.when(
                t.rlike("[-/.,]"), F.concat(F.array(t), F.split(t, "[-/.,]+"))
            ).otherwise(F.array(t)),
        )
    )
    return F.array_distinct(
        F.filter(with_parts, lambda t: (t != "") & ~t.isin(K.STOPWORDS))
    )


def tokenize(cell: Column) -> Column:
    return tokens(normalize(cell))


def title_snippet(title_tokens: Column, n: int = 5) -> Column:
    return F.array_join(F.slice(title_tokens, 1, n), " ")


def index_terms(text: Column, pattern: str = K.INDEX_TERM_PATTERN) -> Column:
    """Terms of the full-text index, with multiplicity: text split at everything else."""
    return F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(1))


def search_terms(retrieval_tokens: Column, limit: int = 8) -> Column:
    """Distinct index terms of a query, first ``limit`` of them."""
    return F.slice(F.array_distinct(index_terms(F.array_join(retrieval_tokens, " "))), 1, limit)


def has_letter_and_digit(token: Column) -> Column:
    return token.rlike(f"[{K.LETTERS}]") & token.rlike(r"\d")


def number_and_unit(normalized: Column) -> Column:
    """First number of normalised text with the unit that follows it."""
    digits = F.regexp_extract(normalized, K.NUMBER_PATTERN, 1)
    unit = F.nullif(F.regexp_extract(normalized, K.NUMBER_PATTERN, 2), F.lit(""))
    return F.struct(
        digits.try_cast("double").alias("value"),
        F.when(digits != "", unit).alias("unit"),
    )


def looks_like_unit(token: Column) -> Column:
    return token.isin(K.UNITS) | (F.regexp_extract(token, K.NUMBER_PATTERN, 2) != "")


def stem(token: Column) -> Column:
    """Token with Cyrillic letters and no digits, without its longest listed ending.

    Three characters must remain; tokens of up to four keep their form.
    """
    ending = "|".join(K.SUFFIXES)
    return F.when(
        (F.length(token) > 4) & token.rlike(f"[{K.CYRILLIC}]") & ~has_letter_and_digit(token),
        F.regexp_replace(token, f"^(.{{3,}}?)(?:{ending})$", "$1"),
    ).otherwise(token)


def lemma(token: Column, term_type: Column) -> Column:
    """Stem of a plain Russian word; brands, models, units and compounds keep their form."""
    fixed = term_type.isin("brand", "model", "unit") | token.isin(K.UNITS)
    return F.when(~fixed & token.rlike("^[а-я]+$"), stem(token)).otherwise(token)


def layout_variant(token: Column) -> Column:
    """The same keys typed in the other keyboard layout; null if mixed or unchanged."""
    latin = token.rlike("[a-z]")
    cyrillic = token.rlike(f"[{K.CYRILLIC}]")
    typed = F.when(latin & ~cyrillic, F.translate(token, K.LATIN_KEYS, K.CYRILLIC_KEYS)).when(
        cyrillic & ~latin, F.translate(token, K.CYRILLIC_KEYS, K.LATIN_KEYS)
    )
    return F.when((typed != "") & (typed != token), typed)


def layout_direction(token: Column) -> Column:
    latin, cyrillic = token.rlike("[a-z]"), token.rlike("[а-я]")
    return (
        F.when(latin & ~cyrillic, "en_to_ru").when(cyrillic & ~latin, "ru_to_en").otherwise("mixed")
    )


def infer_term_type(token: Column) -> Column:
    """Type of a term seen in the catalogue."""
    return (
        F.when(looks_like_unit(token), "unit")
        .when(has_letter_and_digit(token), "model")
        .when(token.isin(K.KNOWN_BRANDS), "brand")
        .when(token.rlike(r"\d"), "model")
        .otherwise("token")
    )


def requested_type(token: Column, dictionary_type: Column) -> Column:
    """Type of a query token: the dictionary's if it has one."""
    return F.coalesce(
        dictionary_type,
        F.when(looks_like_unit(token), "unit").when(token.rlike(r"\d"), "model").otherwise("token"),
    )


def is_protected(token: Column, token_type: Column) -> Column:
    """Tokens that spelling correction must leave alone."""
    return (
        (F.length(token) < 4)
        | token_type.isin("model", "unit")
        | looks_like_unit(token)
        | has_letter_and_digit(token)
    )


def parse_attributes(raw: Column) -> Column:
    """``name:value`` pairs of a raw attribute cell, numbered, with search forms and numbers."""
    chunks = F.filter(
        F.split(clean(raw), "[;|]+"), lambda chunk: chunk.contains(":")
    )
    pairs = F.filter(
        F.transform(
            chunks,
            lambda chunk: F.struct(
                clean(F.split_part(chunk, F.lit(":"), F.lit(1))).alias("name"),
                clean(F.regexp_replace(chunk, "^[^:]*:", "")).alias("value"),
            ),
        ),
        lambda pair: (pair["name"] != "") & (pair["value"] != ""),
    )
    return F.transform(
        pairs,
        lambda pair, i: F.struct(
            (i + 1).alias("pos"),
            pair["name"].alias("name_raw"),
            normalize(pair["name"]).alias("name_norm"),
            pair["value"].alias("value_raw"),
            normalize(pair["value"]).alias("value_norm"),
            number_and_unit(normalize(pair["value"]))["value"].alias("numeric_value"),
            number_and_unit(normalize(pair["value"]))["unit"].alias("unit"),
        ),
    )


def attribute_map(raw: Column) -> Column:
    """Attributes as a map split on ``;`` only; a repeated name keeps its last value."""
    pairs = F.filter(
        F.transform(
            F.filter(F.split(F.coalesce(raw, F.lit("")), ";"), lambda chunk: chunk.contains(":")),
            lambda chunk: F.struct(
                F.trim(F.split_part(chunk, F.lit(":"), F.lit(1))).alias("key"),
                F.trim(F.regexp_replace(chunk, "^[^:]*:", "")).alias("value"),
            ),
        ),
        lambda pair: (pair["key"] != "") & (pair["value"] != ""),
    )
    last_wins = F.filter(
        pairs,
        lambda pair, i: ~F.exists(
            F.slice(pairs, i + 2, F.size(pairs)), lambda later: later["key"] == pair["key"]
        ),
    )
    return F.map_from_entries(last_wins)


def dedupe_attributes(attributes: Column) -> Column:
    """Attributes without repeats of (name, value, number), first one kept."""

    def identity(a: Column) -> Column:
        return F.struct(
            F.coalesce(F.nullif(a["name_norm"], F.lit("")), a["name_raw"], F.lit("")).alias("n"),
            F.coalesce(F.nullif(a["value_norm"], F.lit("")), a["value_raw"], F.lit("")).alias("v"),
            F.coalesce(a["numeric_value"].cast("string"), F.lit("")).alias("x"),
        )

    return F.filter(
        attributes,
        lambda a, i: ~F.exists(F.slice(attributes, 1, i), lambda b: identity(a) == identity(b)),
    )


def seed_canonical(token: Column) -> Column:
    seeds = F.create_map(*[F.lit(x) for pair in K.SEED_SYNONYMS.items() for x in pair])
    return F.coalesce(F.try_element_at(seeds, token), token)


def guess_brand(title_tokens: Column) -> Column:
    """First plain Latin word among the first six tokens, capitalised."""
    words = F.transform(F.slice(title_tokens, 1, 6), seed_canonical)
    return F.initcap(F.get(F.filter(words, lambda w: w.rlike("^[a-z]{3,}$")), F.lit(0)))


def guess_model(title_tokens: Column) -> Column:
    """First token with letters and digits, in capitals."""
    return F.upper(F.get(F.filter(title_tokens, has_letter_and_digit), F.lit(0)))


def plain_search_text(*fields: Column) -> Column:
    """Lower-cased concatenation of the given fields, empty ones left out."""
    return F.lower(F.concat_ws(" ", *[F.nullif(f, F.lit("")) for f in fields]))
