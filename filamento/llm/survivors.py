"""One surviving record for each group of duplicate records.

Fields that depend on one another are chosen as whole bundles: a filing bundle (receipt number, name,
correction flag, day, time, number of the original, filer), a firm bundle (stock code, name, market)
and a period bundle (month). Branch and bound picks one candidate of every bundle so that total trust
is greatest among the choices that keep the functional dependencies between bundles. Trust has two
levels: the order of filings comes strictly first, the rest decides among choices with one filing.
"""

from __future__ import annotations

from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from filamento.functions.codes import corp_code, day8, stock_code
from filamento.functions.udf import arrow
from filamento.plans.runtime import materialize, salted_join

#: Kinds of a filing by trust: as first filed, attachment filed, material correction.
ORIGINAL, ATTACHMENT, MATERIAL = 0, 1, 2


def _plain(name: Column) -> Column:
    """A report name with full-width brackets and spaces written plainly."""
    return F.regexp_replace(F.translate(name, "（）［］／．　", "()[]/. "), "(?U)\\s+", "")


def normalized(filings: DataFrame) -> DataFrame:
    """Rows of a filings index with plain codes, the kind and period the name tells, and the day.

    A bracket states the kind: any material-correction bracket (기재정정) is material, an
    attachment bracket (첨부…) is an attachment, another bracket material. A name that is no annual
    report gives ``annual`` false, a missing one null.
    """
    name = _plain(F.col("report_nm"))
    bracket = F.regexp_extract(name, r"^((?:\[[^\]]*\])+)", 1)
    bare = F.regexp_replace(name, r"^(?:\[[^\]]*\])+", "")
    kind = F.when(F.coalesce(bracket, F.lit("")) == "", None).when(bracket.contains("첨부"), ATTACHMENT).otherwise(MATERIAL)
    period = F.regexp_extract(bare, r"\(([12][0-9]{3})[./-]?[0-9]{0,2}\)", 1)
    return filings.where(F.col("rcept_no").isNotNull()).select(
        F.trim("rcept_no").alias("rcept_no"),
        corp_code(F.col("corp_code")).alias("corp"),
        stock_code(F.col("stock_code")).alias("stock"),
        F.coalesce(F.when(period != "", period.cast("bigint")), F.col("fy").cast("bigint")).alias("year"),
        (period != "").alias("year_named"),
        bare.rlike(r"^사업보고서(?:\(|$)").alias("annual"),
        kind.alias("kind"),
        F.col("is_correction").alias("flag"),
        day8(F.col("rcept_dt")).alias("day"),
        *[F.when(F.trim(c) != "", F.trim(c)).alias(c) for c in ("report_nm", "rcept_time", "orig_rcept_no", "flr_nm", "corp_name", "market")],
        "period_month", "collected_at",
    )


#: Fields of one filing that are taken together, and those of a firm besides its code.
DETAILS, FIRM = ("report_nm", "rcept_time", "orig_rcept_no", "flr_nm"), ("corp_name", "market")


def _fullest(fields: tuple[str, ...], name: str) -> Column:
    """Of a filing's rows, the values of the one that tells most of ``fields``; of equals the last
    collected, then the greatest values. Values of different rows are never mixed."""
    told = sum((F.col(c).isNotNull().cast("int") for c in fields), F.lit(0))
    return F.max(F.struct(told.alias("told"), "collected_at", *fields)).alias(name)


def filings(rows: DataFrame) -> DataFrame:
    """One row per receipt number: all its rows describe one filing, with ``n`` rows counted.

    A bracket in any row states the kind; without one a true correction flag makes a material
    correction, else the filing is as first filed. The day is the earliest stated one, else the first
    eight digits of the number. Of several codes, months or kinds the greatest counts.
    """
    one = rows.groupBy("rcept_no").agg(
        F.count(F.lit(1)).alias("n"),
        F.max("corp").alias("corp"),
        F.max("stock").alias("stock"),
        F.coalesce(F.max(F.when(F.col("year_named"), F.col("year"))), F.max("year")).alias("year"),
        F.coalesce(F.bool_or("annual"), F.lit(True)).alias("annual"),
        F.coalesce(F.max("kind"), F.when(F.bool_or(F.coalesce("flag", F.lit(False))), MATERIAL).otherwise(ORIGINAL)).alias("kind"),
        F.coalesce(F.min("day"), day8(F.col("rcept_no"))).alias("day"),
        F.max("period_month").alias("period_month"),
        _fullest(DETAILS, "details"),
        _fullest(FIRM, "named"),
    )
    one = materialize(one, "filings")
    # a firm's stock code tells the corp code where that is missing: the dependency stock -> corp
    firm = one.where("stock is not null and corp is not null").groupBy("stock").agg(F.mode("corp", True).alias("known_corp"))
    missing = one.where("corp is null and stock is not null")
    filled = salted_join(missing, firm, ["stock"], "left").withColumn("corp", F.col("known_corp")).drop("known_corp")
    return one.where("corp is not null or stock is null").unionByName(filled)


Trust = tuple[float, float]


def choose(bundles: list[list[dict]]) -> list[dict] | None:
    """Best consistent choice of one candidate per bundle, by branch and bound.

    A candidate's ``trust`` has two levels; levels are summed over a choice and compared in order, so
    nothing on the second outweighs the first. Candidates come sorted by falling trust (ties by ``tie``).
    A dependency holds when two chosen candidates that both name a value of a shared field (``firm``,
    ``month``) name the same one. The bound of a partial choice adds the greatest trust of each open
    bundle. None if every choice breaks a dependency.
    """
    plus = lambda a, b: (a[0] + b[0], a[1] + b[1])
    rest: list[Trust] = [(0.0, 0.0)] * (len(bundles) + 1)
    for i in range(len(bundles) - 1, -1, -1):
        rest[i] = plus(rest[i + 1], max((c["trust"] for c in bundles[i]), default=(0.0, 0.0)))
    best: tuple[Trust, list[dict]] | None = None

    def extend(i: int, chosen: list[dict], trust: Trust, facts: dict) -> None:
        nonlocal best
        if best is not None and plus(trust, rest[i]) <= best[0]:
            return
        if i == len(bundles):
            best = (trust, list(chosen))
            return
        for c in bundles[i]:
            clash = any(c[f] is not None and facts.get(f) is not None and facts[f] != c[f] for f in ("firm", "month"))
            if not clash:
                extend(i + 1, [*chosen, c], plus(trust, c["trust"]), facts | {f: c[f] for f in ("firm", "month") if c[f] is not None})

    extend(0, [], (0.0, 0.0), {})
    return best[1] if best else None


def bundles(facts: list[dict]) -> list[list[dict]]:
    """Candidates of a group's filing, firm and period bundles, by falling trust.

    ``facts`` holds, per combination of stock code, month, name and market, the first of its filings
    and the rows ``n`` that tell it. Trust of a filing is its place in the order of filings; of a firm
    or month what it tells, then the share of rows that tell it. Nothing known is always a candidate,
    so the first filing can always be chosen.
    """
    total = sum(f["n"] for f in facts)
    order = {no: -place for place, (_, _, no) in enumerate(sorted((f["best"]["kind"], f["best"]["day"] or "", f["best"]["rcept_no"]) for f in facts))}
    filing = [{"trust": (float(order[f["best"]["rcept_no"]]), 0.0), "tie": f["best"]["rcept_no"], "firm": f["stock"], "month": f["period_month"], "value": f["best"]} for f in facts]
    firms, months = Counter({(None, None, None): 0}), Counter({None: 0})
    for f in facts:
        firms[f["stock"], f["corp_name"], f["market"]] += f["n"]
        months[f["period_month"]] += f["n"]
    told = lambda values: sum(v is not None for v in values)
    last = lambda values: tuple((v is None, v if v is not None else "") for v in values)
    firm = [{"trust": (0.0, told(v) + n / (total + 1)), "tie": last(v), "firm": v[0], "month": None, "value": v} for v, n in firms.items()]
    period = [{"trust": (0.0, told([m]) + n / (total + 1)), "tie": (m is None, m or 0), "firm": None, "month": m, "value": m} for m, n in months.items()]
    falling = lambda c: ((-c["trust"][0], -c["trust"][1]), c["tie"])
    return [sorted(b, key=falling) for b in (filing, firm, period)]


_CHOSEN = T.StructType([*(T.StructField(n, T.StringType()) for n in ("rcept_no", "rcept_dt", *DETAILS, "stock_code", *FIRM)), T.StructField("is_correction", T.BooleanType()), T.StructField("period_month", T.IntegerType())])
_ARROW = pa.struct([(f.name, {"string": pa.string(), "boolean": pa.bool_(), "int": pa.int32()}[f.dataType.simpleString()]) for f in _CHOSEN])


@arrow(_CHOSEN)
def _pick(groups: pa.Array) -> pa.Array:
    out = []
    for facts in groups.to_pylist():
        filing, firm, period = (c["value"] for c in choose(bundles(facts)))
        out.append({"rcept_no": filing["rcept_no"], "rcept_dt": filing["day"], **{c: filing["details"][c] for c in DETAILS}, "is_correction": filing["kind"] == MATERIAL, "period_month": period, **dict(zip(("stock_code", *FIRM), firm))})
    return pa.array(out, _ARROW)


def survivors(rows: DataFrame) -> DataFrame:
    """(corp_code, fy, n, corrected, then the surviving record): one row per group.

    ``rows`` are raw filings. Groups are the annual reports of one firm and year with two or more
    rows. Filings without a firm or year belong to no group. The record holds every field of the
    surviving filing (rcept_no, rcept_dt, rcept_time, report_nm, is_correction, orig_rcept_no,
    flr_nm), and stock_code, corp_name, market and period_month, which the other filings of the group
    tell where the chosen one does not. ``corrected`` says whether the group holds a material
    correction. Filings with equal facts are reduced to the first of them by a map-side combined
    aggregate before a group's facts meet, so a group of any size becomes a few candidates.
    """
    f = filings(normalized(rows)).where("annual and corp is not null and year is not null")
    first = F.min(F.struct("kind", "day", "rcept_no", "details")).alias("best")
    facts = f.groupBy("corp", "year", "stock", "period_month", "named.corp_name", "named.market").agg(F.sum("n").alias("n"), first, F.bool_or(F.col("kind") == MATERIAL).alias("corrected"))
    groups = facts.groupBy("corp", "year").agg(F.sum("n").alias("n"), F.bool_or("corrected").alias("corrected"), F.collect_list(F.struct("stock", "period_month", "corp_name", "market", "n", "best")).alias("facts")).where("n >= 2")
    return groups.select(F.col("corp").alias("corp_code"), F.col("year").alias("fy"), "n", "corrected", _pick("facts").alias("p")).select("corp_code", "fy", "n", "corrected", "p.*")
