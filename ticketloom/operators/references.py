"""References between records: reading them from text fields, and finding those whose target does not exist."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ticketloom.storage import materialize

#: Bits of the Bloom filter for each key, and bits that a key sets. The filter has at most MOST_WORDS words of 64 bits
#: (32 MB, some 27 million keys at these bits); it is broadcast in rows of ROW_WORDS words.
BITS_PER_KEY, BLOOM_BITS, MOST_WORDS, ROW_WORDS = 10, 4, 1 << 22, 64


def named_id(token: Column) -> Column:
    """The number a token names: the run of digits at its trimmed end, else null (also beyond 64 bits)."""
    return F.regexp_extract(token, r"([0-9]+)[\s\p{Z}]*$", 1).try_cast("bigint")


def named_ids(field: Column, separator: str = r"\|\|") -> Column:
    """Distinct ids named by a separated text field; a null field gives an empty array."""
    ids = F.transform(F.split(field, separator), named_id)
    return F.coalesce(F.array_distinct(F.array_compact(ids)), F.array().cast("array<bigint>"))


def _word(key: Column, words: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(words))


def _mask(key: Column) -> Column:
    h = F.xxhash64(key, F.lit(17))
    mask = F.lit(0).cast("bigint")
    for k in range(BLOOM_BITS):
        bit = F.shiftrightunsigned(h, 6 * k).bitwiseAND(F.lit(63)).cast("int")
        mask = mask.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("bigint"), bit))
    return mask


def bloom_words(n_keys: int, most: int = MOST_WORDS) -> int:
    """Words of a filter for so many keys: a power of two. Beyond `most` the filter proves less and the exact join decides more."""
    need = -(-n_keys * BITS_PER_KEY // 64)
    return min(most, 1 << max(need - 1, ROW_WORDS - 1).bit_length())


def bloom_filter(keys: DataFrame, key: str, words: int) -> DataFrame:
    """A blocked Bloom filter as a table (row, masks) of at most words / ROW_WORDS rows: each key sets BLOOM_BITS bits of one word."""
    word = _word(F.col(key), words)
    masks = keys.where(F.col(key).isNotNull()).groupBy(word.alias("word")).agg(F.bit_or(_mask(F.col(key))).alias("mask"))
    rows = masks.groupBy(F.shiftright("word", 6).alias("row")).agg(F.map_from_entries(F.collect_list(F.struct(F.col("word").bitwiseAND(F.lit(ROW_WORDS - 1)).alias("k"), "mask"))).alias("m"))
    dense = F.transform(F.sequence(F.lit(0), F.lit(ROW_WORDS - 1)), lambda k: F.coalesce(F.try_element_at("m", k.cast("bigint")), F.lit(0).cast("bigint")))
    return rows.select("row", dense.alias("masks"))


def bloom_split(rows: DataFrame, key: str, bloom: DataFrame, words: int) -> DataFrame:
    """rows with the column `maybe`: false proves that the key is in no row the filter was made of. The filter's size is bounded (MOST_WORDS), so it is broadcast."""
    need = _mask(F.col(key))
    at = _word(F.col(key), words)
    mask = F.get("__masks", at.bitwiseAND(F.lit(ROW_WORDS - 1)).cast("int"))
    return (
        rows.withColumn("__row", F.shiftright(at, 6))
        .join(F.broadcast(bloom.withColumnRenamed("row", "__row").withColumnRenamed("masks", "__masks")), "__row", "left")
        .withColumn("maybe", F.coalesce(mask.bitwiseAND(need) == need, F.lit(False)))
        .drop("__row", "__masks")
    )


def references(rows: DataFrame, fields: list[str], id_col: str = "issue_id", time_col: str = "loaded_at") -> DataFrame:
    """Distinct references (issue_id, field_name, target_issue_id, month) of every row, one per row's calendar month."""
    named = F.array(*[
        F.struct(F.lit(f).alias("field_name"), named_ids(F.col(f)).alias("targets")) for f in fields
    ])
    return (
        rows.select(F.col(id_col).alias("issue_id"), F.trunc(F.col(time_col).cast("date"), "month").alias("month"), F.explode(named).alias("n"))
        .select("issue_id", "month", "n.field_name", F.explode("n.targets").alias("target_issue_id"))
        .distinct()
    )


def orphan_references(rows: DataFrame, deleted: DataFrame, fields: list[str], id_col: str = "issue_id",
                      time_col: str = "loaded_at", deleted_col: str = "deleted_at", most_words: int = MOST_WORDS,
                      keep_sound: bool = False, report: dict | None = None) -> DataFrame:
    """References to records that are missing, deleted or come later.

    A reference is an orphan if, at the end of the calendar month of the naming row's load, its target has no row
    loaded yet or is deleted. A broadcast Bloom filter of the keys that have rows, of a size that follows their number
    up to most_words, proves orphans outright; only filter-positive references are joined with the keys. References are
    read and marked once and written to the shared folder.

    Result: issue_id, field_name, target_issue_id, period ('yyyy-MM'), and with keep_sound every reference with the
    flag is_orphan. report: a dictionary that gets n_keys, n_references and n_proven. Nulls: a null or blank field names
    nothing; a null issue_id is kept as null; a row without a load time has no month and its references are reported
    with a null period as orphans only if the target has no row at all; a target row without load time counts as never
    loaded. Repeated rows count once. Empty tables give no rows.
    """
    keys = materialize(rows.groupBy(F.col(id_col).alias("target_issue_id")).agg(F.min(F.col(time_col).cast("date")).alias("first_loaded")), "keys")
    gone = deleted.groupBy(F.col(id_col).alias("target_issue_id")).agg(F.min(F.col(deleted_col).cast("date")).alias("gone_at"))
    n_keys = keys.count()
    words = bloom_words(n_keys, most_words)
    bloom = bloom_filter(keys, "target_issue_id", words)
    refs = materialize(bloom_split(references(rows, fields, id_col, time_col), "target_issue_id", bloom, words), "references")
    if report is not None:
        n, proven = refs.agg(F.count("*"), F.count_if(~F.col("maybe"))).first()
        report.update(n_keys=n_keys, n_references=n, n_proven=proven)
    end = F.add_months("month", 1)
    proven = refs.where(~F.col("maybe")).withColumn("is_orphan", F.lit(True))
    verified = (
        refs.where("maybe")
        .join(keys, "target_issue_id", "left").hint("merge")
        .join(gone.hint("merge"), "target_issue_id", "left")
        .withColumn("is_orphan", F.col("first_loaded").isNull() | F.coalesce((F.col("first_loaded") >= end) | (F.col("gone_at") < end), F.lit(False)))
    )
    cols = ["issue_id", "field_name", "target_issue_id", F.date_format("month", "yyyy-MM").alias("period")]
    both = proven.select(*cols, "is_orphan").unionByName(verified.select(*cols, "is_orphan"))
    return both if keep_sound else both.where("is_orphan").drop("is_orphan")


def orphan_report(orphans: DataFrame) -> DataFrame:
    """Counts per field and period of orphan_references(keep_sound=True): references, orphans, distinct missing targets."""
    return orphans.groupBy("field_name", "period").agg(
        F.count("*").alias("n_references"),
        F.count_if("is_orphan").alias("n_orphans"),
        F.count_distinct(F.when(F.col("is_orphan"), F.col("target_issue_id"))).alias("n_missing_targets"),
    )
