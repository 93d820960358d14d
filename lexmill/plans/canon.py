"""p5: law names as entered, assigned to the register."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.functions.plain_sql import composed, literal, plain_name, run_sql
from lexmill.operators.canon_map import closest_entries
from lexmill.session import spread, write_shared
from lexmill.sources.tables import table

# Remarks around a name that do not change what is meant, and signs that never do.
LEADING = r"^(?:\((?:구|舊|현행|종전)\)|[ '「『<\[(《〈“‘\x22]|舊|현행|종전의?|구 (?=.))+"
TRAILING = (
    r"(?:[ '」』>\])》〉”’.,;:、。\x22]|등|\(약칭\)|\((?:법률|대통령령|총리령|부령|[가-힣]{2,12}(?:부령|훈령|예규|고시))?제?\d+호\)"
    r"|\((?:구|현행|개정|이하)[^)]*\)|제\d+조(?:의\d+)?(?:제\d+항)?(?:제\d+(?:의\d+)?호)?(?:[가-하]목)?|별표\d*)+$"
)
SIGNS = r"[ ·,.\-/'‘’“”\x22]"


def _readings(names: DataFrame) -> DataFrame:
    """(value, reading): a name without remarks, blanks and signs; a leading 구 or a misspelt 현행 may be a remark or not."""
    spark = names.sparkSession
    flat = run_sql(spark, f"SELECT value, {plain_name('value')} AS s FROM {{n}}", n=names)
    whole = run_sql(spark, f"SELECT value, {composed('s')} AS s FROM {{f}}", f=flat)
    bare = run_sql(
        spark,
        f"""SELECT value, regexp_replace(regexp_replace(regexp_replace(regexp_replace(s, {literal(LEADING)}, ''), ' ', ''), {literal(TRAILING)}, ''), {literal(SIGNS)}, '') AS s FROM {{w}}""",
        w=whole,
    )
    return run_sql(spark, "SELECT DISTINCT value, reading FROM {b} LATERAL VIEW explode(CASE WHEN s LIKE '구%' THEN array(s, substr(s, 2)) WHEN s LIKE '현%' THEN array(s, substr(s, 2), substr(s, 3), substr(s, 4)) ELSE array(s) END) r AS reading WHERE length(s) > 0", b=bare)


def _entries(register: DataFrame) -> DataFrame:
    """(entry_id, text): official and short names without blanks and signs, also with 에 관한 or 및 left out."""
    return run_sql(
        register.sparkSession,
        f"""SELECT DISTINCT reg_id AS entry_id, regexp_replace(text, {literal(SIGNS)}, '') AS text
            FROM {{r}} LATERAL VIEW explode(array(official_name, short_name, replace(official_name, '에 관한', ''), replace(official_name, ' 및 ', ''), replace(replace(official_name, '에 관한', ''), ' 및 ', ''))) t AS text WHERE length(text) > 0""",
        r=register,
    )


def _places(register: DataFrame) -> DataFrame:
    """(entry_id, word): the place an entry is named after, the first word of its name up to the middle dot."""
    return run_sql(
        register.sparkSession,
        "SELECT reg_id AS entry_id, regexp_extract(official_name, '^[^ ·]+', 0) AS word FROM {r} WHERE official_name IS NOT NULL",
        r=register,
    )


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each law name not written as in the register, with the entry it means or 0.

    Names are reduced to their distinct values before anything is compared; the
    register, the only table held against them, is fixed in size.
    """
    register = table(spark, sf_dir, "law_register").select("reg_id", "official_name", "short_name")
    rows = None
    for src, rec_id, name in (("citations", "id", "law_name"), ("findings", "id", "law_name"), ("laws", "law_id", "name")):
        part = table(spark, sf_dir, src).select(F.lit(src).alias("src"), F.col(rec_id).cast("string").alias("rec_id"), F.col(name).alias("value")).where(F.col(name).isNotNull())
        rows = part if rows is None else rows.unionByName(part)
    rows = run_sql(spark, "SELECT r.* FROM {r} r LEFT ANTI JOIN {g} g ON r.value = g.official_name", r=rows, g=register)
    # Written, because the optimizer would drop this distinct for the one over the readings above it.
    names = spread(write_shared(rows.select("value").distinct(), "names"))
    meant = write_shared(closest_entries(write_shared(_readings(names), "readings"), write_shared(_entries(register), "entries"), write_shared(_places(register), "places")), "meant")
    assigned = run_sql(spark, "SELECT r.src, r.rec_id, m.entry_id AS reg_id FROM {r} r JOIN {m} m ON r.value = m.value", r=rows, m=meant)
    unmatched = run_sql(spark, "SELECT r.src, r.rec_id, 0 AS reg_id FROM {r} r LEFT ANTI JOIN {m} m ON r.value = m.value", r=rows, m=meant)
    return assigned.unionByName(unmatched)


QUERIES = {"p5_found": p5_found}
