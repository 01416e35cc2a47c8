"""Whether a quote supports the catalyst it is cited for, and what became of a stored judgement. Column expressions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C

# They must equal those of the tool whose results these operators match.
MERGER_WORDS = ("acqui", "merger", "definitive agreement", "completion", "purchase of", "sale of", "tender offer")
EARNINGS = r"\$[\d,\.]+|\d+\s*%|revenue|earnings per|eps|net income|net loss|operating income|gross profit|beat|bookings|arr|margin|cash flow"
GUIDANCE = r"guidance|forecast|outlook|raised|lowered|revised|expect\w*\s+\w*\s*(revenue|earnings|profit|sales)|revenue|earnings|\$[\d,\.]+|\d+\s*%"
GUIDANCE_BOILERPLATE = ("business update", "investor presentation", "investor conference", "investor day", "will use the information", "will be providing", "conference call", "earnings call", "presentation at")
OFFICERS = r"\b(chief executive officer|ceo|chief financial officer|cfo|chief operating officer|coo|founder)\b|(?<!vice )(?<!senior vice )(?<!executive vice )\bpresident\b"
CHAIR = r"\b(executive chairman|chairman of the board)\b|company.{0,6}s\s+chairman|\bserve as\s+\S*\s*chairman\b|\bappointed\s+\S*\s*chairman\b|\bchairman\b"
TURNAROUND = r"\b(founder|activist|turnaround|restructur|strategic review|succession|transition|incoming\s+(ceo|cfo|coo)|new\s+(ceo|cfo|coo)|chief executive|chief financial|chief operating)\b"
DEBT_WORDS = ("aggregate principal amount", "senior secured notes", "subordinated notes", "notes due", "issued $", "principal amount of", "aggregate principal")
PAY_WORDS = ("annual base salary", "annual salary", "base salary", "salary increase", "compensation increase", "increase of $")
BOARD_WORDS = ("nominees for director", "elected to the company's board", "elected to the board of directors", "board of directors of the company", "appointed to the board of directors", "fiscal council", "audit committee", "has been reviewed and approved", "eligibility requirements")
PRODUCT = r"phase\s*[123]|topline results?|top.line results?|primary analysis|positive results?|fda approval|ema approval|received approval|launched|commercially available|approval of|approved for|major customer|customer win|selected by|agreement to deploy|clinical trial|trial results?|efficacy|pivotal study"
REGULATORY = r"settlement agreement|consent decree|asset freeze|fda approval|ema approval|received approval|regulatory approval|commercial deliveries|first\s+(lng\s+)?cargo|first deliveries|fines of|\$[\d,\.]+\s*(million|billion)?\s*settl|settl\w*\s+\$[\d,\.]+|enforcement action|criminal charge|indictment|material fine"


def weakness(kind: Column, quote: Column) -> Column:
    """Why the quote does not support the kind of catalyst; empty where it does. Kinds without a rule are always supported."""
    q = F.lower(F.coalesce(quote, F.lit("")))
    has = lambda words: C.any_of([F.contains(q, F.lit(w)) for w in words])
    fine = F.lit("")
    money = q.rlike(EARNINGS)
    by_kind = {
        "merger_acquisition": F.when(has(MERGER_WORDS), fine).otherwise("no_ma_keyword"),
        "earnings": F.when(money, fine).when(F.contains(q, F.lit("press release")), "pr_wrapper_no_financials").otherwise("no_financial_metrics"),
        "guidance": F.when(q.rlike(GUIDANCE), fine).when(has(GUIDANCE_BOILERPLATE), "conference_or_update_boilerplate").otherwise("no_guidance_language"),
        "management_change": F.when(has(DEBT_WORDS), "debt_issuance_misclassified").when(has(PAY_WORDS), "compensation_not_catalyst").when(q.rlike(CHAIR), F.when(q.rlike(TURNAROUND), fine).otherwise("routine_chair_appointment")).when(q.rlike(OFFICERS), fine).when(has(BOARD_WORDS), "routine_board_governance").otherwise("weak_management_change"),
        "product_launch": F.when(q.rlike(PRODUCT), fine).otherwise("weak_product_or_project_update"),
        "regulatory": F.when(q.rlike(REGULATORY), fine).otherwise("routine_regulatory_disclosure"),
    }
    out = fine
    for name, reason in by_kind.items():
        out = F.when(kind == name, reason).otherwise(out)
    return out


def revalidate(df: DataFrame) -> DataFrame:
    """Stored judgements (kind, quote, sentiment, note, status, counts, model_counts) judged again: status, reason and whether they count. Notes with
    [SKIP] or [ERROR] pass as they are; a quote once found invalid stays so; `model_counts` null means the stored `counts`."""
    note, weak = F.coalesce("note", F.lit("")), weakness(F.col("kind"), F.col("quote"))
    final = F.contains(note, F.lit("[SKIP]")) | F.contains(note, F.lit("[ERROR]"))
    bad = F.contains(note, F.lit("[INVALID_QUOTE]"))
    says = F.coalesce("model_counts", "counts", F.lit(False))
    flat = says & ~F.coalesce(F.col("sentiment"), F.lit("neutral")).isin("bullish", "bearish")
    status = F.when(final, F.col("status")).when(bad, "invalid_quote").when(weak != "", "weak_evidence").when(flat, "neutral_sentiment").otherwise("valid")
    reason = F.when(final | bad, F.lit(None)).when(weak != "", weak).when(flat, "neutral_or_mixed_sentiment").otherwise("")
    return df.withColumns({"new_status": status, "reason": reason, "new_counts": F.when(final, F.col("counts")).when(bad | (weak != "") | flat, False).otherwise(says)})


def insights(reviews: DataFrame, runs: DataFrame) -> DataFrame:
    """reviews (tier, useful, flaw, lacks, rejected, ret) and runs (source, failed) to (category, subject, n, value, severity): one row for each rule whose
    count and value pass its bound. One pass over each table."""
    named = F.coalesce(C.any_of([F.contains(F.lower("lacks"), F.lit(w)) for w in ("peer", "sector", "comparable")]), F.lit(False))
    flaw, a = F.coalesce("flaw", F.lit("")), (F.col("tier") == "A") & F.col("useful").isNotNull()
    risen = F.col("rejected") & F.coalesce(F.col("ret") > 0.10, F.lit(False))
    x = reviews.agg(F.count_if(a).alias("a"), F.avg(F.when(a, F.col("useful"))).alias("useful"), F.count_if(flaw == "weak_catalyst").alias("weak"), F.count_if(flaw == "overstated_case").alias("over"), F.count_if((flaw == "missing_peer_context") | named).alias("peer"), F.count_if(risen).alias("risen"), F.avg(F.when(risen, F.col("ret"))).alias("gain"), F.count_if(flaw.isin("bad_data", "stale_data")).alias("stale"))
    none = F.lit(None).cast("double")
    rules = (("scorecard_weakness", "A", "a", "useful", 3, "high"), ("catalyst_rules", None, "weak", None, 3, "medium"), ("text_quality", None, "over", None, 2, "medium"), ("feature_gap", None, "peer", None, 2, "medium"), ("rejection_rule", None, "risen", "gain", 3, "low"), ("data_quality", None, "stale", None, 2, "high"))
    made = [F.when((F.col(n) >= least) & (F.col(v) < 2.5 if n == "a" else F.lit(True)), F.struct(F.lit(cat).alias("category"), F.lit(sub).cast("string").alias("subject"), F.col(n).alias("n"), (F.col(v) if v else none).alias("value"), F.lit(sev).alias("severity"))) for cat, sub, n, v, least, sev in rules]
    out = x.select(F.inline(F.array_compact(F.array(*made))))
    rate = runs.groupBy("source").agg(F.count_if("failed").alias("n"), (F.count_if("failed") * 100.0 / F.count("*")).alias("value")).filter("value > 30")
    return out.unionByName(rate.select(F.lit("source_reliability").alias("category"), F.col("source").alias("subject"), "n", "value", F.lit("high").alias("severity")))
