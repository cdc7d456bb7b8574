"""The register's tables as views of the test tables.

The test data has no study register.  These views give line items, orders and suppliers
the columns of country-level records and of the reviewed sponsor sheet.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from duelens.functions.dates import due_date_cutoff
from duelens.operators.lookup import lookup_join
from duelens.operators.rollup import by_study, latest_by_key
from duelens.schema import SPONSOR_KEYS

# Fixed value: host the rendered record pages pretend to come from.
PAGE_HOST = "https://www.clinicaltrialsregister.eu"


# Columns of the test tables, so that no file is opened to find them.
TABLES = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
    "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, "
    "l_quantity double, l_extendedprice double, l_discount double, l_tax double, "
    "l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, "
    "value double, props string",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "pages": "page_id bigint, url string, html string",
}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.schema(TABLES[name]).parquet(f"{folder}/{name}.parquet")


def raw_lines(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "lineitem")


def lines(spark: SparkSession, folder: str, parts: int | None = None) -> DataFrame:
    """Line items made unique by order and line number (a few numbers occur twice).

    They are dealt by study first, so that everything counted by study afterwards stays where it is; into
    ``parts`` partitions, if given, whatever their bytes.
    """
    order = [
        "l_shipdate",
        "l_extendedprice",
        "l_partkey",
        "l_suppkey",
        "l_quantity",
        "l_discount",
        "l_tax",
        "l_returnflag",
        "l_linestatus",
    ]
    raw = raw_lines(spark, folder).withColumn("eudract_number", F.col("l_orderkey").cast("string"))
    return latest_by_key(by_study(raw, parts), ["eudract_number", "l_linenumber"], order)


# The columns of a record, from order key o, line number n, quantity q, discount d and
# tax t in percent.
STATUS = """
CASE
  WHEN o % 12 <= 3 AND l_returnflag = 'R' AND q > 40 THEN 'Prematurely Ended'
  WHEN o % 12 <= 3 THEN 'Completed'
  WHEN o % 12 = 4 THEN 'Prematurely Ended'
  WHEN o % 12 = 5 THEN if(l_returnflag = 'R', 'Restarted', 'Ongoing')
  WHEN o % 12 = 6 THEN if(l_returnflag = 'A', 'Completed', 'Ongoing')
  WHEN o % 12 = 8 THEN if(l_linestatus = 'O', 'Temporarily Halted', 'Suspended by CA')
  WHEN o % 12 = 9 THEN if(l_linestatus = 'O', 'Not Authorised', 'Prohibited by CA')
  WHEN o % 12 = 10 THEN 'Withdrawn'
  WHEN o % 12 = 11 AND l_returnflag = 'A' THEN 'Completed'
  WHEN o % 12 = 11 AND l_returnflag = 'R' THEN 'Withdrawn'
END"""

RECORD_COLUMNS = {
    "eudract_number": "eudract_number",
    "eudract_number_with_country": (
        "concat_ws('-', o, if(n = 7 AND t >= 4, '3rd', cast(n AS string)))"
    ),
    "date_of_the_global_end_of_the_trial": """
        CASE WHEN o % 5 <> 0 AND NOT (o % 5 = 1 AND l_linestatus = 'O') AND o % 12 <> 7
             THEN to_date(l_shipdate) END""",
    "trial_is_part_of_a_paediatric_investigation_plan": (
        "CASE WHEN o % 7 = 0 THEN q > 25 WHEN o % 7 <> 1 THEN false END"
    ),
    "end_of_trial_status": STATUS,
    "trial_status": STATUS,
    "trial_human_pharmacology_phase_i": (
        "CASE WHEN o % 9 = 0 THEN true WHEN o % 9 = 1 THEN q > 10 WHEN q < 50 THEN false END"
    ),
    "trial_therapeutic_exploratory_phase_ii": "o % 9 IN (2, 3)",
    "trial_therapeutic_confirmatory_phase_iii": "o % 9 IN (4, 5, 6)",
    "trial_therapeutic_use_phase_iv": "o % 9 = 7 AND q > 5",
    "trial_bioequivalence_study": """
        CASE WHEN o % 11 = 0 THEN true WHEN o % 11 <= 6 THEN false
             WHEN o % 11 > 7 THEN d >= 5 END""",
    "subject_healthy_volunteers": """
        CASE WHEN o % 6 = 0 THEN true WHEN o % 6 < 4 THEN false WHEN o % 6 > 4 THEN d >= 5 END""",
    "trial_condition_being_studied_is_a_rare_disease": """
        CASE WHEN o % 8 = 0 THEN 'Yes' WHEN o % 8 <= 3 THEN 'No'
             WHEN o % 8 = 4 THEN 'Information not present in EudraCT'
             WHEN o % 8 > 5 THEN CASE l_returnflag WHEN 'A' THEN 'Yes' WHEN 'N' THEN 'No'
                  ELSE 'Information not present in EudraCT' END END""",
    "trial_single_blind": """
        CASE WHEN o % 13 < 2 THEN true WHEN o % 13 < 8 THEN false
             WHEN o % 13 > 8 THEN t >= 4 END""",
    "full_title_of_the_trial": """
        CASE WHEN o % 23 = 0 THEN 'nan' WHEN d > 0 THEN concat('Study ', o, '\\r\\n of ',
             repeat('long-term follow-up ', q div 4)) END""",
    "name_or_abbreviated_title_of_the_trial_where_available": (
        "CASE WHEN t > 0 THEN concat('S-', o, '/', n) END"
    ),
    "trial_results": (
        "CASE WHEN o % 17 < 6 OR (o % 17 < 12 AND q > 20) THEN 'View results' END"
    ),
}

SPONSOR_SPELLING = """
CASE n % 3 WHEN 0 THEN upper(s_name) WHEN 1 THEN replace(s_name, 'u', 'ü') ELSE s_name END"""

SPONSOR_STATUS = """
CASE WHEN s_acctbal >= 4500 THEN 'Non-Commercial' WHEN s_acctbal >= 0 THEN 'Commercial' END"""


def _entry(keys: list[str], name: str, status: str) -> str:
    """A sponsor entry of which only name and status are known."""
    known = {"name_of_sponsor": name, "status_of_the_sponsor": status}
    fields = [f"'{k}', {known.get(k, 'cast(NULL AS string)')}" for k in keys]
    return f"named_struct({', '.join(fields)})"


def _sponsors(keys: list[str]) -> str:
    first = _entry(keys, SPONSOR_SPELLING, SPONSOR_STATUS)
    second = _entry(keys, "concat(s_name, ' Ltd.')", "cast(NULL AS string)")
    return f"""
CASE WHEN d = 10 THEN slice(array({first}), 1, 0)
     WHEN d = 0 AND t = 0 THEN NULL
     WHEN n = 1 AND d >= 5 THEN array({first}, {second})
     ELSE array({first}) END"""


def protocol_records(
    spark: SparkSession,
    folder: str,
    sponsors: bool = True,
    scrapes: bool = False,
    sponsor_keys: list[str] = SPONSOR_KEYS,
    parts: int | None = None,
) -> DataFrame:
    """Country-level records: one per order and line number.

    ``sponsors`` adds the nested sponsor list (a join with suppliers) with ``sponsor_keys`` as fields of
    its entries, ``scrapes`` the month of the order as time of the last scrape (a join with orders). ``parts`` is for ``lines``.
    """
    rows = lines(spark, folder, parts).selectExpr(
        "eudract_number",
        "l_orderkey AS o",
        "l_linenumber AS n",
        "cast(l_quantity AS int) AS q",
        "cast(round(l_discount * 100) AS int) AS d",
        "cast(round(l_tax * 100) AS int) AS t",
        "l_suppkey",
        "l_returnflag",
        "l_linestatus",
        "l_shipdate",
    )
    columns = dict(RECORD_COLUMNS)
    if sponsors:
        supplier = table(spark, folder, "supplier").selectExpr(
            "s_suppkey AS l_suppkey", "s_name", "s_acctbal"
        )
        rows = lookup_join(rows, supplier, ["l_suppkey"])
        columns["sponsors"] = _sponsors(sponsor_keys)
    if scrapes:
        months = table(spark, folder, "orders").selectExpr(
            "o_orderkey AS o", "cast(date_trunc('month', o_orderdate) AS timestamp) AS seen"
        )
        rows = rows.join(months, "o")
        columns["meta_updated"] = "seen"
    return rows.selectExpr(*[f"{sql} AS {name}" for name, sql in columns.items()])


def last_scrape(spark: SparkSession, folder: str) -> Column:
    """Day of the newest order, as a scalar subquery."""
    orders = table(spark, folder, "orders")
    return orders.agg(F.to_date(F.max("o_orderdate")).alias("d")).scalar()


def cutoff(spark: SparkSession, folder: str) -> Column:
    return due_date_cutoff(last_scrape(spark, folder))


def sponsor_sheet(spark: SparkSession, folder: str, complete: bool = True) -> DataFrame:
    """Two reviewed names per supplier, a nation as sponsor, one level of parents.

    Without ``complete`` some of the names have not been reviewed yet.
    """
    nation = table(spark, folder, "nation").join(
        table(spark, folder, "region"), F.expr("n_regionkey = r_regionkey")
    )
    suppliers = (
        table(spark, folder, "supplier")
        .join(nation, F.expr("s_nationkey = n_nationkey"))
        .selectExpr(
            "explode(array(s_name, concat(s_name, ' Ltd.'))) AS name_of_sponsor",
            """CASE WHEN s_suppkey % 50 = 7 THEN concat('Unclear Sponsor Name Given - ', s_name)
                    WHEN s_suppkey % 50 = 8 THEN 'Unknown Sponsor'
                    ELSE concat(n_name, ' Unit ', s_suppkey % 3) END AS normalized_name""",
            """CASE WHEN s_suppkey % 50 = 7 THEN 'Unclear Sponsor Name Given'
                    WHEN s_suppkey % 50 = 8 THEN 'Unknown Sponsor'
                    WHEN s_suppkey % 3 < 2 THEN concat(n_name, ' Unit 0')
                    WHEN s_acctbal >= 5000 THEN concat(r_name, ' Holdings')
                    ELSE 'Independent Holdings' END AS normalized_parent_name""",
            """if(s_suppkey % 5 = 0, concat('https://proof.example/', s_suppkey), '')
               AS Proof""",
            "if(s_suppkey % 5 = 1, 'merged', '') AS Description",
            "'' AS Notes",
            "s_suppkey AS k",
        )
    )
    if not complete:
        suppliers = suppliers.where("NOT (k % 10 = 9 AND name_of_sponsor LIKE '% Ltd.')")
    no_name = spark.range(1).selectExpr(
        "'' AS name_of_sponsor",
        "'No Sponsor Name Given' AS normalized_name",
        "'No Sponsor Name Given' AS normalized_parent_name",
        "'' AS Proof",
        "'' AS Description",
        "'' AS Notes",
    )
    return suppliers.drop("k").unionByName(no_name)


def _escaped(value: Column) -> Column:
    for char, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        value = F.replace(value, F.lit(char), F.lit(entity))
    return value


def _cells(key: str, value: Column, code: str = "") -> Column:
    """One table row: code, key cell, value cell; nothing for a missing value."""
    start = f'<tr><td class="first">{code}</td><td class="second">{key}</td><td class="third">'
    return F.coalesce(
        F.concat(F.lit(start), _escaped(value), F.lit("</td></tr>\n")),
        F.lit(start + "</td></tr>\n"),
    )


def _coded(code: str, value: Column) -> Column:
    """A row that is known by its code only."""
    start = F.lit(f"<tr><td>{code}</td><td>Number of subjects</td><td>")
    return F.concat(start, value.cast("string"), F.lit("</td></tr>\n"))


def _products(many: Column) -> Column:
    """As many products as asked for (none to two); the first is the tested one and has a trade name."""
    tested = F.concat(
        _cells("IMP Role", F.lit("Test"), "D.1.2"),
        _cells("Trade name", F.concat(F.lit("Drug & Co "), "eudract_number"), "D.2.1.1.1"),
    )
    compared = _cells("IMP Role", F.lit("Comparator"), "D.1.2")
    return F.concat(
        F.when(many > 0, tested).otherwise(F.lit("")), F.when(many > 1, compared).otherwise(F.lit(""))
    )


def _yes_no(value: Column) -> Column:
    return F.when(value, "Yes").when(~value, "No")


def record_pages(spark: SparkSession, folder: str) -> DataFrame:
    """Every country-level record as a register page (url, html)."""
    r = F.col
    number = r("eudract_number").cast("long")
    header = [
        ("EudraCT Number:", r("eudract_number")),
        ("Trial Status:", r("trial_status")),
        ("Trial results", r("trial_results")),
    ]
    top = F.concat(
        *[
            F.coalesce(
                F.concat(
                    F.lit(f'<tr><td class="cellGrey">{key}</td><td class="cellLighterGrey">'),
                    _escaped(value),
                    F.lit("</td></tr>\n"),
                ),
                F.lit(""),
            )
            for key, value in header
        ]
    )

    def section(ident: str, *rows: Column) -> Column:
        return F.concat(F.lit(f'<table id="{ident}">\n'), *rows, F.lit("</table>\n"))

    section_begin = '<tr><td class="first">B.1.1</td><td class="second">Name of Sponsor</td>'
    sponsor_rows = F.array_join(
        F.transform(
            F.coalesce(r("sponsors"), F.slice(r("sponsors"), 1, 0)),
            lambda s: F.concat(
                F.lit(section_begin + '<td class="third">'),
                _escaped(s["name_of_sponsor"]),
                F.lit("</td></tr>\n"),
                F.coalesce(
                    F.concat(
                        F.lit('<tr><td>B.3</td><td class="second">Status of the sponsor</td>'),
                        F.lit('<td class="third">'),
                        s["status_of_the_sponsor"],
                        F.lit("</td></tr>\n"),
                    ),
                    F.lit(""),
                ),
            ),
        ),
        "",
    )
    coded = (
        '<tr><td>F.1.1</td><td class="second">Trial has subjects under 18</td>'
        '<td class="third">No</td></tr>\n'
        "<tr><td>F.1.1</td><td>Number of subjects</td><td>"
    )
    html = F.concat(
        F.lit('<html><body><table class="summary">\n'),
        top,
        F.lit('<tr><td><a href="../'),
        r("eudract_number"),
        F.lit('/results">View</a></td></tr></table>\n'),
        section(
            "section-a",
            _cells("EudraCT number", r("eudract_number"), "A.2"),
            _cells("Full title of the trial", r("full_title_of_the_trial"), "A.3"),
            _cells(
                "Name or abbreviated title of the trial where available",
                r("name_or_abbreviated_title_of_the_trial_where_available"),
                "A.3.2",
            ),
            _cells(
                "Trial is part of a Paediatric Investigation Plan",
                _yes_no(r("trial_is_part_of_a_paediatric_investigation_plan")),
                "A.7",
            ),
        ),
        section("section-b", F.coalesce(sponsor_rows, F.lit(""))),
        section(
            "section-e",
            _cells(
                "Condition being studied is a rare disease",
                r("trial_condition_being_studied_is_a_rare_disease"),
            ),
            _cells(
                "Human pharmacology (Phase I)", _yes_no(r("trial_human_pharmacology_phase_i"))
            ),
            _cells("Bioequivalence study", _yes_no(r("trial_bioequivalence_study"))),
            _cells(
                "Therapeutic exploratory (Phase II)",
                _yes_no(r("trial_therapeutic_exploratory_phase_ii")),
            ),
            _cells(
                "Therapeutic confirmatory (Phase III)",
                _yes_no(r("trial_therapeutic_confirmatory_phase_iii")),
            ),
            _cells(
                "Therapeutic use (Phase IV)", _yes_no(r("trial_therapeutic_use_phase_iv"))
            ),
            _cells("Single blind", _yes_no(r("trial_single_blind"))),
            _cells("Other", F.lit("No")),
            _cells("Not in the form", F.lit("x")),
        ),
        section("section-d", _products(number % 3)),
        section(
            "section-d8",
            F.when(
                number % 2 == 0,
                F.concat(
                    _cells("Is a Placebo used in this Trial?", F.lit("Yes"), "D.8.1"),
                    _cells("Pharmaceutical form of the placebo", F.lit("Tablet"), "D.8.3"),
                ),
            ).otherwise(F.lit("")),
        ),
        section(
            "section-f",
            F.concat(F.lit(coded), F.length("eudract_number").cast("string"), F.lit("</td></tr>")),
            _coded("F.1.2.1", number % 100),
            _coded("F.1.3.1", number % 7),
            _cells("Healthy volunteers", _yes_no(r("subject_healthy_volunteers"))),
        ),
        section(
            "section-n",
            _cells("Competent Authority Decision", F.when(number % 4 < 3, "Authorised"), "N."),
            _cells(
                "Date of Competent Authority Decision",
                F.date_add(F.lit("2004-01-01").cast("date"), (number % 300).cast("int")).cast("string"),
                "N.",
            ),
        ),
        section(
            "section-p",
            _cells("End of Trial Status", r("end_of_trial_status")),
            _cells(
                "Date of the global end of the trial",
                r("date_of_the_global_end_of_the_trial").cast("string"),
            ),
        ),
        F.lit("</body></html>"),
    )
    country = F.regexp_extract("eudract_number_with_country", "-(.*)$", 1)
    url = F.concat(
        F.lit(f"{PAGE_HOST}/ctr-search/trial/"), r("eudract_number"), F.lit("/"), country
    )
    # Pages would come from files; here they are made where the narrow lines lie, which would be merged
    # into few partitions because their bytes are few, while reading pages is work for every core.
    # There are as many partitions as other shuffles have, so that a task's share stays small.
    parts = max(
        spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))
    )
    rows = protocol_records(spark, folder, parts=parts)
    return rows.select(url.alias("url"), html.alias("html"))
