"""Queries over the texts themselves: parsing, extraction, judging, diffs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.functions.text import finding_grade, name_key, normalize_text, unit_label
from lexmill.operators import articles as A
from lexmill.operators import citations as C
from lexmill.operators import diff as D
from lexmill.operators.report import in_order, report_items
from lexmill.plans import pipeline as P
from lexmill.plans import views as V
from lexmill.plans.registry import Registry
from lexmill.plans.scalars import PREFIXES
from lexmill.session import spread
from lexmill.sources.source import FrameSource, Source, TableSource
from lexmill.sources.tables import table

R = Registry()


def _ordinances(spark: SparkSession, sf: str) -> DataFrame:
    return P.delivered(TableSource(spark, sf))


@R.query()
def ordinance_articles(spark: SparkSession, sf: str) -> DataFrame:
    return A.parsed_articles(_ordinances(spark, sf), "mst", rows=A.ordinance_rows).select("mst", "pos", "label", "is_article", "title", F.col("content").alias("body"))


@R.query()
def ordinance_meta(spark: SparkSession, sf: str) -> DataFrame:
    """Heads of the ordinances as their bodies state them, with the full text."""
    return A.ordinance_meta(_ordinances(spark, sf))


@R.query()
def law_articles(spark: SparkSession, sf: str) -> DataFrame:
    """Articles of the stored laws, administrative rules of any style included."""
    return A.parsed_articles(table(spark, sf, "laws"), "law_id", rows=A.rule_rows)


@R.query(r"""WITH f AS (SELECT law_id, coalesce(body_xml, '') AS b FROM laws),
 e AS (SELECT law_id, trim(regexp_extract(b, '<시행일자>\s*(?:<!\[CDATA\[)?\s*([^<\]]*?)\s*(?:\]\]>)?\s*</시행일자>', 1)) AS enforce_date, trim(regexp_extract(b, '<제개정구분>\s*(?:<!\[CDATA\[)?\s*([^<\]]*?)\s*(?:\]\]>)?\s*</제개정구분>', 1)) AS revise_type,
 trim(regexp_extract(b, '<공포일자>\s*(?:<!\[CDATA\[)?\s*([^<\]]*?)\s*(?:\]\]>)?\s*</공포일자>', 1)) AS d, trim(regexp_extract(b, '<공포번호>\s*(?:<!\[CDATA\[)?\s*([^<\]]*?)\s*(?:\]\]>)?\s*</공포번호>', 1)) AS n FROM f)
 SELECT law_id, enforce_date, revise_type, CASE WHEN d <> '' OR n <> '' THEN d || '|' || n END AS signature FROM e""")
def law_version_sig(spark: SparkSession, sf: str) -> DataFrame:
    return A.law_meta(table(spark, sf, "laws")).select("law_id", "enforce_date", "revise_type", "signature")


_ROWS = "(SELECT DISTINCT l_orderkey, l_linenumber AS n, 1 + l_partkey % 9 AS h, 1 + l_suppkey % 5 AS g, (l_quantity::INT % 4) AS o FROM lineitem)"


def _rows(spark: SparkSession, sf: str) -> DataFrame:
    c = F.col
    return table(spark, sf, "lineitem").select("l_orderkey", c("l_linenumber").alias("n"), (1 + c("l_partkey") % 9).alias("h"), (1 + c("l_suppkey") % 5).alias("g"), (c("l_quantity").cast("int") % 4).alias("o")).distinct()


@R.query(f"""SELECT l_orderkey AS law_id, label, CASE WHEN max(h) % 2 = 0 THEN 'Y' ELSE 'N' END AS changed, string_agg('제' || n || '조 본문' || h, chr(10) ORDER BY h, g, o) AS content FROM (SELECT *, '제' || n || '조' AS label FROM {_ROWS}) GROUP BY l_orderkey, n, label""")
def law_articles_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    """Law bodies made of rows, and the articles read back from them."""
    per = _rows(spark, sf).groupBy("l_orderkey", "n").agg(F.max("h").alias("h"), F.collect_list(F.struct("h", "g", "o")).alias("x"))
    unit = F.array_join(F.transform(F.array_sort("x"), lambda x: F.concat(F.lit("<항><항내용>제"), F.col("n"), F.lit("조 본문"), x["h"], F.lit("</항내용></항>"))), "")
    xml = F.concat(F.lit("<조문단위><조문여부>조문</조문여부><조문번호>"), F.col("n"), F.lit("</조문번호><조문변경여부>"), F.when(F.col("h") % 2 == 0, "Y").otherwise("N"), F.lit("</조문변경여부>"), unit, F.lit("</조문단위>"))
    body = per.select("l_orderkey", F.struct("n", xml.alias("u")).alias("u")).groupBy("l_orderkey").agg(F.array_sort(F.collect_list("u")).alias("u"))
    laws = body.select(F.col("l_orderkey").alias("law_id"), F.concat(F.lit("<법령><조문>"), F.array_join(F.transform("u", lambda x: x["u"]), ""), F.lit("</조문></법령>")).alias("body_xml"))
    return A.parsed_articles(laws, "law_id").select("law_id", "label", F.when(F.col("changed"), "Y").otherwise("N").alias("changed"), "content")


@R.query()
def extract_citations(spark: SparkSession, sf: str) -> DataFrame:
    """Citations read from the ordinances' own texts."""
    return C.extract_citations(_ordinances(spark, sf), prefixes=PREFIXES).select("mst", "ord_seq", "article_no", "law_name", "cite_type", "clause", "alias_source", "span_start", "span_end")


@R.query(f"""SELECT l_orderkey * 100000 + n * 10000 + h * 1000 + g * 10 + o AS doc, unnest([1, 2, 3, 4]) AS ord_seq, unnest(['법' || h || '률', '법' || h || '률' || CASE WHEN o % 2 = 0 THEN ' 시행령' ELSE '' END, '도로' || '법', '법' || h || '률']) AS law_name,
 unnest(['제' || n || '조제' || g || '항', '제' || g || '조', '제' || h || '조', '제' || (n + 1) || '조부터 제' || (n + 2) || '조까지']) AS clause, unnest(['inline', 'carry_over', 'naked', 'alias']) AS alias_source FROM {_ROWS}""")
def extract_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    """Texts made of rows with all ways of citing, and the citations read back from them."""
    r = _rows(spark, sf)
    c = F.col
    text = F.concat(
        F.lit("「법"), c("h"), F.lit('률」(이하 "약칭"이라 한다) 제'), c("n"), F.lit("조제"), c("g"), F.lit("항에 따라 같은 "), F.when(c("o") % 2 == 0, "법 시행령").otherwise("법"), F.lit(" 제"), c("g"),
        F.lit("조와 도로법 제"), c("h"), F.lit("조를 보고 약칭 제"), c("n") + 1, F.lit("조부터 제"), c("n") + 2, F.lit("조까지 본다."),
    )
    docs = r.select((c("l_orderkey") * 100000 + c("n") * 10000 + c("h") * 1000 + c("g") * 10 + c("o")).alias("doc"), text.alias("text"))
    return C.extract_from_text(docs, "doc", "text").select("doc", "ord_seq", "law_name", "clause", "alias_source")


@R.query()
def group_by_law(spark: SparkSession, sf: str) -> DataFrame:
    g = C.group_by_law(C.extract_citations(_ordinances(spark, sf), prefixes=PREFIXES))
    return g.select("mst", "law_name", "cite_type", F.array_join("labels", ",").alias("labels"), F.array_join("bare_articles", ",").alias("bare_articles"), F.array_join("ways", ",").alias("ways"), "first_seq", "naked_any", "naked_only")


@R.query()
def dedup_occurrences(spark: SparkSession, sf: str) -> DataFrame:
    return C.occurrences(C.extract_citations(_ordinances(spark, sf), prefixes=PREFIXES))


@R.query()
def resolve_specs(spark: SparkSession, sf: str) -> DataFrame:
    return C.narrow_specs(C.occurrences(C.extract_citations(_ordinances(spark, sf), prefixes=PREFIXES)))


@R.query("""SELECT event_id, last_value(CASE WHEN event_type = 'purchase' THEN value END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS carried FROM events""")
def carry_over(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").withColumn("carried", F.when(F.col("event_type") == "purchase", F.col("value")))
    return C.carry_forward(e, "user_id", ["ts", "event_id"], "carried", F.to_date("ts")).select("event_id", "carried")


@R.query(f"""SELECT l_orderkey * 100000 + n * 10000 + h * 1000 + g * 10 + o AS doc, '제' || n || '조' AS label, h % 2 = 1 AND o > 0 AS changed, '2024010' || g AS day FROM {_ROWS}""")
def admrul_clause_changed(spark: SparkSession, sf: str) -> DataFrame:
    """Comparison documents made of rows, and which articles they change."""
    c = F.col
    head = F.concat(F.lit("제"), c("n"), F.lit("조(목적)"))
    old = F.concat(F.lit("<조문>"), head, F.lit(" 가나</조문><조문>① 다라 (생 략)</조문>"))
    new = F.concat(F.lit("<조문>"), head, F.lit(" 가 나</조문><조문>(현행과 같음)① 다"), F.when((c("h") % 2 == 1) & (c("o") > 0), "마").otherwise("라"), F.lit("</조문>"))
    xml = F.concat(F.lit("<R><신구법존재여부>Y</신구법존재여부><신조문_기본정보><시행일자>2024.01.0"), c("g"), F.lit("</시행일자></신조문_기본정보><구조문목록>"), old, F.lit("</구조문목록><신조문목록>"), new, F.lit("</신조문목록></R>"))
    docs = _rows(spark, sf).select((c("l_orderkey") * 100000 + c("n") * 10000 + c("h") * 1000 + c("g") * 10 + c("o")).alias("doc"), xml.alias("xml"))
    return A.comparisons(docs, "doc", "xml").select("doc", "label", A.comparison_changed(c("old"), c("new")).alias("changed"), "day")


def _cited(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "citations").where("law_id <> '' AND clause_label <> ''")
    return c.select("law_id", F.explode(F.split("clause_label", ",")).alias("label")).select("law_id", F.trim("label").alias("label")).distinct()


@R.query()
def occurrence_article_join(spark: SparkSession, sf: str) -> DataFrame:
    """Cited labels and whether the current law has such an article."""
    a = law_articles(spark, sf).select("law_id", "label", "title", "enforce_date")
    return _cited(spark, sf).join(a, ["law_id", "label"], "left")


@R.query()
def moved_from_lookup(spark: SparkSession, sf: str) -> DataFrame:
    return A.moved_to(_cited(spark, sf), law_articles(spark, sf))


@R.query()
def renumber_by_content(spark: SparkSession, sf: str) -> DataFrame:
    """Articles of any former version whose label is gone, found again by their text."""
    former = A.parsed_articles(P.versions_of(TableSource(spark, sf)).withColumn("key", F.concat_ws("/", "law_id", "version_mst")), "key", rows=A.rule_rows)
    former = former.select(F.substring_index("key", "/", 1).alias("law_id"), "label", "content").distinct()
    now = law_articles(spark, sf)
    return A.renumbered(former.join(now.select("law_id", "label"), ["law_id", "label"], "left_anti"), now)


@R.query()
def findings_end_to_end(spark: SparkSession, sf: str) -> DataFrame:
    """Ordinance texts to judged citations: extract, resolve, pick the version of the day, compare."""
    return P.findings_of(TableSource(spark, sf), PREFIXES)


@R.query("""SELECT id, replace(replace(replace(replace(replace(substr(x, 1, a), '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#x27;') || '<mark class="cite">' || replace(replace(replace(replace(replace(substr(x, a + 1, b - a), '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#x27;') || '</mark>'
 || replace(replace(replace(replace(replace(substr(x, b + 1), '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#x27;') AS html FROM (SELECT id, raw_text AS x, length(raw_text) // 3 AS a, length(raw_text) // 2 AS b FROM citations WHERE length(raw_text) >= 6)""")
def highlight_spans(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "citations").where("length(raw_text) >= 6")
    n = F.length("raw_text")
    span = lambda a, b, css: F.struct(a.cast("int").alias("start"), b.cast("int").alias("end"), F.lit(css).alias("css"))
    a, b = F.floor(n / 3), F.floor(n / 2)
    spans = F.array(span(b + 1, n + 5, "outside"), span(a, b, "cite"), span(a + 1, b, "overlap"), span(b, b, "empty"))
    return c.select("id", D.highlight(F.col("raw_text"), spans).alias("html"))


@R.query()
def token_diff(spark: SparkSession, sf: str) -> DataFrame:
    """Texts of cited articles then and now as one marked flow, each pair of texts once."""
    source = TableSource(spark, sf)
    j = P.compared(source, P.cited(source, PREFIXES), P.articles_of(source)).where("then IS NOT NULL AND now IS NOT NULL")
    pairs = j.groupBy("law_id", "version_mst", "label").agg(F.first("then").alias("then"), F.first("now").alias("now"))
    return spread(pairs, "law_id", "version_mst", "label").select("law_id", "version_mst", "label", D.unified_html(D.token_diff("then", "now")).alias("html"))


@R.query()
def token_diff_names(spark: SparkSession, sf: str) -> DataFrame:
    """Names of laws then and now as one marked flow."""
    s = table(spark, sf, "law_snapshots").where("name IS NOT NULL").groupBy("law_id").agg(F.min_by("name", F.struct("fetched_at", "name")).alias("then"))
    now = table(spark, sf, "laws").where("name IS NOT NULL").select("law_id", F.col("name").alias("now"))
    return s.join(now, "law_id").select("law_id", D.unified_html(D.token_diff("then", "now")).alias("html"))


@R.query()
def trace_match(spark: SparkSession, sf: str) -> DataFrame:
    """Every stored finding beside the replayed judgement of the same clause and unit, and whether they agree.

    A law is met by its id, without one by its name. What was not replayed does not agree.
    """
    blank = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c)
    law = F.when(F.col("law_id") != "", F.col("law_id")).otherwise(F.concat(F.lit("?"), name_key(F.coalesce("law_name", F.lit(""))))).alias("law")
    keys = ["mst", "law", "ord_clause", "clause_label", "clause_detail"]
    found = findings_end_to_end(spark, sf).select("mst", law, F.col("article_no").alias("ord_clause"), F.col("label").alias("clause_label"), unit_label(F.col("hang"), F.col("ho"), F.col("mok")).alias("clause_detail"), "ord_seq", "severity", "change_type")
    replayed = found.groupBy(*keys).agg(F.min(F.struct("ord_seq", "severity", "change_type")).alias("r"))
    stored = table(spark, sf, "findings").select("id", blank("mst"), law, *map(blank, keys[2:]), F.col("severity").alias("stored"), blank("change_type").alias("stored_change"))
    same = F.col("stored").eqNullSafe(F.col("r.severity")) & (F.col("stored_change") == F.col("r.change_type"))
    match = F.when(F.col("r").isNull(), False).otherwise(same)
    return stored.join(replayed, keys, "left").select("id", "stored", "stored_change", F.col("r.severity").alias("replayed"), F.col("r.change_type").alias("replayed_change"), match.alias("match"))


# ---- one ordinance in full
def detail_articles(source: Source, citations: DataFrame, findings: DataFrame) -> DataFrame:
    """Articles of ordinances with marked citations, how many there are, and how many ask for something.

    citations and findings as stored. A citation asks for something if a finding other than
    current points at its article, law and one of its labels, or at the law as a whole. The
    mark of a span says what it is: of another ordinance, without brackets, of a law, or of
    one that needs nothing. Units without a text are left out.
    """
    blank = lambda c: F.coalesce(F.col(c), F.lit(""))
    c = citations.where("mst IS NOT NULL").select("mst", blank("article_no").alias("label"), blank("law_name").alias("law"), "span_start", "span_end", (F.coalesce("cite_naked", F.lit(0)) != 0).alias("naked"), "cite_type", F.transform(F.split(blank("clause_label"), ","), lambda x: F.trim(x)).alias("labels"))
    grade = finding_grade(F.col("severity"), F.col("change_type"), F.col("cite_naked"), F.col("cite_spacing"))
    open_ = findings.where(grade != "current").select("mst", F.trim(F.substring_index(blank("ord_clause"), ",", 1)).alias("label"), blank("law_name").alias("law"), blank("clause_label").alias("asked"))
    open_ = open_.groupBy("mst", "label", "law").agg(F.collect_set("asked").alias("asked"))  # labels of one law in one article
    j = c.join(open_, ["mst", "label", "law"], "left")
    act = F.coalesce(F.arrays_overlap("labels", "asked") | F.array_contains("asked", ""), F.lit(False))
    local = F.col("cite_type") == "자치법규"
    css = F.when(~act & ~F.coalesce(local, F.lit(False)), "cite-current").when(local, "cite-local").when(F.col("naked"), "cite-naked").otherwise("cite-law")
    span = F.struct(F.coalesce("span_start", F.lit(0)).cast("int").alias("start"), F.coalesce("span_end", F.lit(0)).cast("int").alias("end"), css.alias("css"))
    spans = j.groupBy("mst", "label").agg(F.collect_list(span).alias("spans"), F.count(F.lit(1)).alias("cites"), F.count_if(act).alias("act"))
    units = A.parsed_articles(P.delivered(source), "mst", rows=A.ordinance_rows).where("content != ''").select("mst", "pos", "label", "title", normalize_text(F.col("content")).alias("text"))
    none = F.array().cast("array<struct<start:int,end:int,css:string>>")
    html = D.highlight(F.col("text"), F.coalesce("spans", none))
    zero = lambda x: F.coalesce(x, F.lit(0)).alias(x)
    return units.join(spans, ["mst", "label"], "left").select("mst", "pos", "label", "title", html.alias("html"), zero("cites"), zero("act"))


@R.query()
def ordinance_detail_articles(spark: SparkSession, sf: str) -> DataFrame:
    return detail_articles(TableSource(spark, sf), table(spark, sf, "citations"), table(spark, sf, "findings"))


def ordinance_detail(spark: SparkSession, sf: str, mst: str) -> dict[str, DataFrame]:
    """All views of one ordinance: its row, articles, law cards, cited ordinances, composition, linked laws, report items."""
    one = F.col("mst") == mst
    s = TableSource(spark, sf)
    source = FrameSource(s.ordinances().where(one), s.laws(), s.versions(), s.names())
    cited, found = table(spark, sf, "citations").where(one), table(spark, sf, "findings").where(one)
    local = cited.where("cite_type = '자치법규' AND law_name <> ''").select("mst", "law_name").distinct()
    return {
        "meta": table(spark, sf, "ordinances").where(one).drop("body_xml"),
        "articles": detail_articles(source, cited, found).orderBy("pos"),
        "law_refs": V.law_cards(spark, sf).where(one),
        "local_refs": V.local_targets(local, ["law_name"], V.ordinances(spark, sf)),
        "features": V.cite_features(spark, sf).where(one),
        "linked_refs": V.linked_not_cited(spark, sf).where(one),
        "recommend": in_order(report_items(found, V.ordinances(spark, sf), mst, include_current=True)),
    }
