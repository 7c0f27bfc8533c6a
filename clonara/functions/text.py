"""Scalar rules on sequences, genes, templates and metadata."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from clonara.constants import AMINO_ACIDS, DEFAULT_J, DEFAULT_V, SENTINEL

STRICT = f"^[{AMINO_ACIDS}]+$"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def valid_aa(c) -> Column:
    """Only the twenty standard letters, at least one."""
    return _col(c).rlike(STRICT)


def alpha_seq(c) -> Column:
    """Non-empty and only letters."""
    return _col(c).rlike(r"^\p{L}+$")


def loose_aa(c) -> Column:
    """At least five characters, standard letters or one of ``X*-.`` in any case."""
    c = _col(c)
    return (F.length(c) >= 5) & F.upper(c).rlike(f"^[{AMINO_ACIDS}X*.-]+$")


def clean_seq(c) -> Column:
    """Upper-cased with every unknown character as ``X``; empty becomes null."""
    return F.nullif(F.regexp_replace(F.upper(_col(c)), f"[^{AMINO_ACIDS}X]", "X"), F.lit(""))


def coerce_templates(c) -> Column:
    """Template count as a number; unreadable or missing counts as one."""
    number = _col(c).try_cast("double")
    return F.coalesce(F.nanvl(number, F.lit(None).cast("double")), F.lit(1.0))


def gene_family(c) -> Column:
    head = F.upper(F.substring_index(F.substring_index(_col(c), "*", 1), "-", 1))
    return F.coalesce(F.nullif(head, F.lit("")), F.lit("UNK"))


def gene_norm(c) -> Column:
    return F.coalesce(F.trim(F.substring_index(_col(c), "*", 1)), F.lit("UNKNOWN"))


def gene_family_alt(c) -> Column:
    """Family by ``-`` when present, else by ``/``; placeholders become null."""
    c = _col(c)
    head = F.when(F.contains(c, F.lit("-")), F.substring_index(c, "-", 1)).otherwise(F.substring_index(c, "/", 1))
    return F.when(c.isNotNull() & ~c.isin("", "nan", SENTINEL), head)


def gene_sanitize(c) -> Column:
    return F.translate(_col(c), "*/", "__")


def sentinel_fill(c) -> Column:
    c = _col(c)
    return F.when(c.isNull() | c.isin("", "nan", "None"), F.lit(SENTINEL)).otherwise(c)


def default_v(c) -> Column:
    return F.coalesce(F.nullif(_col(c), F.lit("")), F.lit(DEFAULT_V))


def default_j(c) -> Column:
    return F.coalesce(F.nullif(_col(c), F.lit("")), F.lit(DEFAULT_J))


def finite(c) -> Column:
    c = _col(c)
    return F.when(c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")), F.lit(0.0)).otherwise(c)


def missing_to_null(c) -> Column:
    """The usual CSV spellings of a missing value, all as null."""
    c = _col(c)
    # Spellings read as missing.
    names = ["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL",
             "NaN", "None", "n/a", "nan", "null"]
    return F.when(~c.isin(names), c)


def dataset_id(c) -> Column:
    """First all-digit part of a dataset name, one when there is none."""
    digits = F.regexp_extract(_col(c), r"(^|[_ ])([0-9]+)([_ ]|$)", 2)
    return F.coalesce(F.nullif(digits, F.lit("")).try_cast("int"), F.lit(1))


def encode_tokens(c, max_len: int = 20) -> Column:
    """Letters as 1..20, unknown as 21, cut and right-padded with 0 to a fixed length."""
    letters = F.slice(F.split(_col(c), ""), 1, max_len)
    ids = F.transform(letters, _letter_id)
    padding = F.array_repeat(F.lit(0), F.lit(max_len) - F.size(letters))
    return F.concat(ids, padding)


def _letter_id(ch: Column) -> Column:
    position = F.position(ch, F.lit(AMINO_ACIDS))
    return F.when(position == 0, F.lit(21)).otherwise(position)


def encode_kmers(c, k: int = 3) -> Column:
    """One-based base-20 index of each window, zero when a window has an unknown letter."""
    c = _col(c)

    def index(i: Column) -> Column:
        digit = lambda j: F.position(F.substring(c, i + j, F.lit(1)), F.lit(AMINO_ACIDS))
        value = sum((digit(j) - 1) * 20 ** (k - 1 - j) for j in range(k)) + 1
        known = digit(0) > 0
        for j in range(1, k):
            known = known & (digit(j) > 0)
        return F.when(known, value).otherwise(F.lit(0)).cast("bigint")

    windows = F.transform(F.sequence(F.lit(1), F.length(c) - k + 1), index)
    return F.when(F.length(c) >= k, windows).otherwise(F.array().cast("array<bigint>"))


def metadata_features(metadata, number: str = "dataset_id"):
    """Sex for all; race and run bucket only for dataset 7, HLA typing only for dataset 8.

    The run bucket uses a digest, so it is the same in every run.
    """
    have = set(metadata.columns)
    n = F.col(number)
    flag = lambda cond: F.when(cond, F.lit(1.0)).otherwise(F.lit(0.0))
    cells = []
    if "sex" in have:
        cells.append(("meta_sex_male", F.lit(True), flag(F.upper("sex").isin("M", "MALE"))))
    if "race" in have:
        cells.append(("meta_race_white", n == 7, flag(F.contains(F.lower("race"), F.lit("white")))))
    if "sequencing_run_id" in have:
        run = F.coalesce("sequencing_run_id", F.lit("nan"))
        cells.append(("meta_run_hash", n == 7, F.pmod(F.conv(F.substring(F.md5(run.cast("binary")), 1, 8), 16, 10).cast("long"), F.lit(100)) / 100.0))
    for hla in ("A", "B", "C", "DRB1"):
        if hla in have:
            cells.append((f"meta_hla_{hla}", n == 8, flag(F.col(hla).isNotNull())))
    listed = F.array(*[F.struct(F.lit(f).alias("feature"), when.alias("on"), v.alias("value")) for f, when, v in cells])
    return metadata.select("dataset", "repertoire_id", F.inline(listed)).where("on").drop("on")
