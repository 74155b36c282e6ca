"""The registered queries: Spark code over an operator each, and the same result as SQL for DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from duelgrid import views as V
from duelgrid.functions import prefs as P
from duelgrid.functions import text as T
from duelgrid.operators import battles as B
from duelgrid.operators import calibration as C
from duelgrid.operators import completions as O
from duelgrid.operators import ratings as R
from duelgrid.operators import summary as S
from duelgrid.operators import twoturn as TT
from duelgrid.sources.arenas import finish

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def _docs(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/documents.parquet")


def _judged(spark: SparkSession, sf: str) -> DataFrame:
    return V.view(spark, sf, V.JUDGED)


def _battles(spark: SparkSession, sf: str) -> DataFrame:
    return V.view(spark, sf, V.BATTLES)


# --- DuckDB fragments -------------------------------------------------------------------------------------------------
_CLEAN = r"regexp_replace({t}, '(?is)<think>.*?</think>', '', 'g')"
_STRAY = "(instr(lower({t}), '</think>') > 0 and (instr(lower({t}), '<think>') = 0 or instr(lower({t}), '<think>') > instr(lower({t}), '</think>')))"


def _strip(t: str) -> str:
    clean = _CLEAN.format(t=t)
    return (
        rf"(case when {t} is null then '' when {clean} <> {t} then regexp_replace({clean}, '^\s+', '')"
        rf" when {_STRAY.format(t=t)} then regexp_replace(substr({t}, instr(lower({t}), '</think>') + 8), '^\s+', '') else {t} end)"
    )


def _score(t: str, side: str) -> str:
    return rf"""try_cast(nullif(regexp_extract(lower({_strip(t)}), 'score.*?{side}[": *\n]*(-?\d+)', 1), '') as double)"""


def _pref(t: str, temperature: str = "0.3::double") -> str:
    return f"(1.0::double / (1.0::double + exp({temperature} * ({_score(t, 'a')} - {_score(t, 'b')}))))"


def _verdict(t: str) -> str:
    s = _strip(t)
    return f"(case when contains({s}, '[[A]]') then 'A' when contains({s}, '[[B]]') then 'B' when contains({s}, '[[C]]') then 'tie' else 'error' end)"


def _hash(*parts: str) -> str:
    return f"('0x' || substr(md5(concat_ws('~', {', '.join(parts)})), 1, 8))::bigint"


_SUMMARY = """
count(*) as num_battles, count(*) filter (where pref < 0.5::double) as num_wins, count(*) filter (where pref > 0.5::double) as num_losses,
count(*) filter (where pref = 0.5::double) as num_ties, count(*) - count(pref) as num_missing,
round(case when count(pref) > 0 then (count(*) filter (where pref < 0.5::double) + 0.5::double * count(*) filter (where pref = 0.5::double)) / count(pref) end, 9) as winrate
"""
_DJ = V.JUDGED.replace("as string", "as varchar")
_J = f"with j as ({_DJ}), p as (select *, round({_pref('judge_completion')}, 9) as pref, round({_pref('judge_completion_swapped')}, 9) as pref_swapped from j) "
_B = f"with b as ({V.BATTLES}) "
_H = f"with h as ({V.HUMAN}) "
_OUT = f"with o as ({V.OUTPUTS}) "
_Q = f"with q as ({V.QUESTIONS}) "
_LAST = "l as (select instruction_index, model, arg_max(coalesce(output, ''), ord) as output from o group by all)"


def _with_prefs(df: DataFrame) -> DataFrame:
    return df.withColumns({
        "pref": F.round(P.parsed_preference(F.col("judge_completion")), 9),
        "pref_swapped": F.round(P.parsed_preference(F.col("judge_completion_swapped")), 9),
    })


def _summary(df: DataFrame, *keys: str) -> DataFrame:
    return df.select(*keys, "num_battles", "num_wins", "num_losses", "num_ties", "num_missing", F.round("winrate", 9).alias("winrate"))


# --- parsing ----------------------------------------------------------------------------------------------------------
@query(_J.split(", p as")[0] + f" select event_id, {_score('judge_completion', 'a')} as score_a, {_score('judge_completion', 'b')} as score_b from j")
def parse_scores(spark: SparkSession, sf: str) -> DataFrame:
    t = F.col("judge_completion")
    return _judged(spark, sf).select("event_id", T.score_a(t).alias("score_a"), T.score_b(t).alias("score_b"))


@query(_J + "select event_id, pref from p")
def preference_soft(spark: SparkSession, sf: str) -> DataFrame:
    return _with_prefs(_judged(spark, sf)).select("event_id", "pref")


@query(_J.split(", p as")[0] + f" select event_id, {_strip('judge_completion')} as answer, {_strip('judge_completion')} <> judge_completion as had_thinking from j")
def strip_think(spark: SparkSession, sf: str) -> DataFrame:
    t = F.col("judge_completion")
    return _judged(spark, sf).select("event_id", T.strip_thinking(t).alias("answer"), T.had_thinking(t).alias("had_thinking"))


@query("select doc_id, coalesce(left(text, 200), '') as short, coalesce(left(cast(n_chars as varchar), 3), '') as n from documents")
def truncate_text(spark: SparkSession, sf: str) -> DataFrame:
    return _docs(spark, sf).select("doc_id", T.truncate(F.col("text"), 200).alias("short"), T.safe_text(F.col("n_chars"), 3).alias("n"))


@query(_J.split(", p as")[0] + f" select event_id, {_verdict('judge_completion')} as verdict from j")
def verdict_parse(spark: SparkSession, sf: str) -> DataFrame:
    return _judged(spark, sf).select("event_id", T.verdict(F.col("judge_completion")).alias("verdict"))


_WIN = "case when v = 'A' then 'model_a' when v = 'B' then 'model_b' else v end"
_WIN_SWAPPED = "case when v2 = 'A' then 'model_b' when v2 = 'B' then 'model_a' else v2 end"
_WINNER_PREF = "cast(case {w} when 'model_a' then 0 when 'model_b' then 1 when 'tie' then 0.5 when 'tie (bothbad)' then 0.5 end as double)"
_G = (
    f"with j as ({_DJ}), v as (select *, {_verdict('judge_completion')} as v, {_verdict('judge_completion_swapped')} as v2 from j), "
    f"g as (select *, {_WIN} as g1, {_WIN_SWAPPED} as g2 from v), "
    "r as (select *, case when g1 = 'error' or g2 = 'error' then 'error' when g1 = g2 then g1 else 'tie' end as winner, "
    "g1 <> 'error' and g2 <> 'error' and g1 <> g2 as inconsistent from g) "
)


@query(_G + f"select event_id, g2 as winner, {_WINNER_PREF.format(w='g2')} as pref from g")
def verdict_winner_pref(spark: SparkSession, sf: str) -> DataFrame:
    w = P.verdict_winner(T.verdict(F.col("judge_completion_swapped")), F.lit(True))
    return _judged(spark, sf).select("event_id", w.alias("winner"), P.winner_preference(w).alias("pref"))


@query(_G + f"select event_id, winner, inconsistent, {_WINNER_PREF.format(w='winner')} as pref from r")
def conservative_winner(spark: SparkSession, sf: str) -> DataFrame:
    return TT.resolve_both(_judged(spark, sf)).select("event_id", "winner", "inconsistent", "pref")


@query(_G + "select model, count(*) filter (where inconsistent) as n_inconsistent, count(*) as n_items from r group by model")
def inconsistency_rate(spark: SparkSession, sf: str) -> DataFrame:
    return TT.inconsistencies(TT.resolve_both(_judged(spark, sf)), ["model"])


# --- summaries --------------------------------------------------------------------------------------------------------
@query(_J + f"select {_SUMMARY} from p")
def pref_summary(spark: SparkSession, sf: str) -> DataFrame:
    return _summary(S.pref_summary(_with_prefs(_judged(spark, sf))))


@query(_J + f"select model, {_SUMMARY} from p group by model")
def pref_summary_by_model(spark: SparkSession, sf: str) -> DataFrame:
    return _summary(S.pref_summary(_with_prefs(_judged(spark, sf)), by=["model"]), "model")


@query(
    _J + f"select '' as key, '' as value, {_SUMMARY} from p union all select 'model', model, {_SUMMARY} from p group by model "
    f"union all select 'opponent', opponent, {_SUMMARY} from p group by opponent"
)
def pref_summary_grouping_sets(spark: SparkSession, sf: str) -> DataFrame:
    return _summary(S.pref_summary_each(_with_prefs(_judged(spark, sf)), ["model", "opponent"]), "key", "value")


@query(_J + "select event_id, false as swapped, pref from p union all select event_id, true, round(1 - pref_swapped, 9) from p")
def swap_both_stack(spark: SparkSession, sf: str) -> DataFrame:
    return S.stack_swapped(_with_prefs(_judged(spark, sf))).select("event_id", "swapped", F.round("pref", 9).alias("pref"))


@query(_J + ", s as (select pref from p union all select round(1 - pref_swapped, 9) from p) " + f"select {_SUMMARY} from s")
def swap_both_summary(spark: SparkSession, sf: str) -> DataFrame:
    return _summary(S.pref_summary(S.stack_swapped(_with_prefs(_judged(spark, sf))).withColumn("pref", F.round("pref", 9))))


@query(_J + "select model, count(*) filter (where pref is null) as direct, count(*) filter (where pref_swapped is null) as swapped from p group by model")
def parse_failures(spark: SparkSession, sf: str) -> DataFrame:
    return S.parse_failures(_with_prefs(_judged(spark, sf)), ["model"], direct="pref", swapped="pref_swapped")


@query(_J + "select event_id, case when pos_a then pref else round(1 - pref, 9) end as pref_ours from p")
def our_frame_prefs(spark: SparkSession, sf: str) -> DataFrame:
    return B.in_our_frame(_with_prefs(_judged(spark, sf)), "pos_a").select("event_id", F.round("pref_ours", 9).alias("pref_ours"))


# --- battles ----------------------------------------------------------------------------------------------------------
@query(
    _J + "select event_id, case when pos_a then 'ours' else opponent end as model_a, case when pos_a then opponent else 'ours' end as model_b, "
    "case when pref < 0.5::double then 'model_a' when pref > 0.5::double then 'model_b' else 'tie' end as winner, pref, "
    "cast(case when pref < 0.5::double then 0 when pref > 0.5::double then 1 else 0.5 end as double) as pref_hard from p"
)
def battles_pairs(spark: SparkSession, sf: str) -> DataFrame:
    df = _with_prefs(_judged(spark, sf)).withColumn("ours_is_a", F.col("pos_a"))
    return B.battle_results(df, "ours", keep=["event_id"])


@query(_B + "select model, count(*) as battles from (select unnest([model_a, model_b]) as model from b) group by model")
def battle_counts_per_model(spark: SparkSession, sf: str) -> DataFrame:
    return B.battles_per_model(_battles(spark, sf))


@query(
    _B + ", c as (select model from (select unnest([model_a, model_b]) as model from b) group by model "
    "having count(*) >= (select count(*) * 2 / 25 from b)) "
    "select model_a, model_b, count(*) as battles from b where model_a in (from c) and model_b in (from c) group by all"
)
def well_represented_semi(spark: SparkSession, sf: str) -> DataFrame:
    """Battles collapse to pairs first; the threshold is the mean number of battles of a model."""
    return B.well_represented_pairs(_battles(spark, sf), one_in=25)


@query(_B + "select count(*) as battles, (select count(distinct m) from (select unnest([model_a, model_b]) as m from b)) as models, count(distinct model_a) as languages from b")
def arena_profile(spark: SparkSession, sf: str) -> DataFrame:
    return B.arena_profile(_battles(spark, sf).withColumn("lang", F.col("model_a")))


@query("select doc_id, lang from documents where lang in ('de', 'fr')")
def lang_filter(spark: SparkSession, sf: str) -> DataFrame:
    return B.languages(_docs(spark, sf), ["de", "fr"]).select("doc_id", "lang")


@query("select lang, doc_id from (select lang, doc_id, row_number() over (partition by lang order by doc_id) as r from documents) where r <= 20")
def per_language_head(spark: SparkSession, sf: str) -> DataFrame:
    return B.head_per_group(_docs(spark, sf).select("lang", "doc_id"), 20, "lang", "doc_id")


@query("select doc_id, source from documents order by doc_id limit 50")
def head_n(spark: SparkSession, sf: str) -> DataFrame:
    return B.head(_docs(spark, sf).select("doc_id", "source"), 50, "doc_id")


@query("select doc_id from documents order by md5('7~' || cast(doc_id as varchar)), doc_id limit 100")
def seeded_sample(spark: SparkSession, sf: str) -> DataFrame:
    return B.seeded_sample(_docs(spark, sf).select("doc_id"), 100, "doc_id", 7)


@query(
    _H + f"select battle_id, {_hash(chr(39) + '7' + chr(39), chr(39) + 'opponent' + chr(39), 'battle_id::varchar')} % 2 = 0 as opponent_is_a, "
    f"{_hash(chr(39) + '7' + chr(39), chr(39) + 'position' + chr(39), 'battle_id::varchar')} % 2 = 0 as ours_is_a from h"
)
def coin_flips(spark: SparkSession, sf: str) -> DataFrame:
    return B.assign_opponents(V.view(spark, sf, V.HUMAN), 7).select("battle_id", "opponent_is_a", "ours_is_a")


@query(
    _H + f"select battle_id, case when {_hash(chr(39) + '7' + chr(39), chr(39) + 'opponent' + chr(39), 'battle_id::varchar')} % 2 = 0 "
    "then model_a else model_b end as opponent from h"
)
def opponent_pick(spark: SparkSession, sf: str) -> DataFrame:
    return B.assign_opponents(V.view(spark, sf, V.HUMAN), 7).select("battle_id", "opponent")


@query(_H + f"select battle_id, winner, {_WINNER_PREF.format(w='winner')} as pref from h")
def human_labels_to_pref(spark: SparkSession, sf: str) -> DataFrame:
    return V.view(spark, sf, V.HUMAN).select("battle_id", "winner", P.winner_preference(F.col("winner")).alias("pref"))


_UNION = f"with j as ({_DJ}), p as (select *, round({_pref('judge_completion')}, 9) as pref from j), h as ({V.HUMAN}), u as (" \
    "select model as model_a, opponent as model_b, pref from p where model <> opponent " \
    f"union all select model_a, model_b, {_WINNER_PREF.format(w='winner')} from h) "


def _union(spark: SparkSession, sf: str) -> DataFrame:
    llm = _with_prefs(_judged(spark, sf)).where("model <> opponent").select(F.col("model").alias("model_a"), F.col("opponent").alias("model_b"), "pref")
    human = V.view(spark, sf, V.HUMAN).select("model_a", "model_b", P.winner_preference(F.col("winner")).alias("pref"))
    return llm.unionByName(human)


@query(_UNION + "select model_a, model_b, count(*) as battles, count(pref) as parsed, round(sum(pref), 6) as points_b from u group by all")
def union_llm_human(spark: SparkSession, sf: str) -> DataFrame:
    return _union(spark, sf).groupBy("model_a", "model_b").agg(F.count("*").alias("battles"), F.count("pref").alias("parsed"), F.round(F.sum("pref"), 6).alias("points_b"))


# --- ratings ----------------------------------------------------------------------------------------------------------
@query(_B + "select model_a, model_b, sum(1 - pref) as points_a, sum(pref) as points_b, count(*) as battles from b where pref is not null group by all")
def bt_sufficient_stats(spark: SparkSession, sf: str) -> DataFrame:
    return R.sufficient_statistics(_battles(spark, sf))


@query(
    _B + ", t as (select case when model_a = 'Brand#11' then 1 - pref else pref end as x from b where (model_a = 'Brand#11' and model_b = 'Brand#12') "
    "or (model_a = 'Brand#12' and model_b = 'Brand#11')), s as (select avg(x) as p from t) "
    "select 'Brand#11' as model, round(1000 + 200 * log10(p / (1 - p)), 6) as rating from s union all "
    "select 'Brand#12', round(1000 - 200 * log10(p / (1 - p)), 6) from s"
)
def bt_ratings_two_model(spark: SparkSession, sf: str) -> DataFrame:
    two = ["Brand#11", "Brand#12"]
    df = _battles(spark, sf).where(F.col("model_a").isin(*two) & F.col("model_b").isin(*two))
    return R.ratings_frame(spark, R.fit_bradley_terry(df)).withColumn("rating", F.round("rating", 6))


@query()
def bt_ratings(spark: SparkSession, sf: str) -> DataFrame:
    return R.ratings_frame(spark, R.fit_bradley_terry(_battles(spark, sf))).withColumn("rating", F.round("rating", 6))


@query()
def bt_ratings_anchored(spark: SparkSession, sf: str) -> DataFrame:
    return R.ratings_frame(spark, R.fit_bradley_terry(_battles(spark, sf), baseline="Brand#11")).withColumn("rating", F.round("rating", 6))


_BALANCE = "select model, 0.0::double as residual from (select unnest([model_a, model_b]) as model from b where pref is not null) group by model"


def _balance(spark: SparkSession, battles: DataFrame, ratings: dict[str, float]) -> DataFrame:
    """What each model won beyond what its rating expects, which a best fit makes zero."""
    rated = R.ratings_frame(spark, ratings)
    pairs = R.sufficient_statistics(battles).where("model_a <> model_b")
    sides = [rated.select(F.col("model").alias(f"model_{s}"), F.col("rating").alias(s)) for s in "ab"]
    joined = pairs.join(sides[0], "model_a").join(sides[1], "model_b")
    expected = F.col("battles") / (1 + F.pow(F.lit(10.0), (F.col("b") - F.col("a")) / 400))
    gain = F.col("points_a") - expected
    both = joined.select(F.explode(F.array(F.struct(F.col("model_a").alias("model"), gain.alias("g")), F.struct(F.col("model_b").alias("model"), (-gain).alias("g")))).alias("x"))
    # zero has no sign here
    return both.groupBy("x.model").agg((F.round(F.sum("x.g"), 4) + F.lit(0.0)).alias("residual"))


@query(_B + _BALANCE)
def bt_ratings_balance(spark: SparkSession, sf: str) -> DataFrame:
    df = _battles(spark, sf)
    return _balance(spark, df, R.fit_bradley_terry(df))


@query(_B + _BALANCE.replace("0.0::double as residual", "0.0::double as residual, case when model = 'Brand#11' then 1000.0::double end as anchor"))
def bt_anchored_balance(spark: SparkSession, sf: str) -> DataFrame:
    df = _battles(spark, sf)
    ratings = R.fit_bradley_terry(df, baseline="Brand#11")
    anchor = F.when(F.col("model") == "Brand#11", F.lit(ratings["Brand#11"]))
    return _balance(spark, df, ratings).withColumn("anchor", F.round(anchor, 6))


@query()
def bt_bootstrap_leaderboard(spark: SparkSession, sf: str) -> DataFrame:
    df = _battles(spark, sf)
    return R.leaderboard(R.bootstrap(df, 20, 11), B.battles_per_model(df), "Brand#11")


@query(_B + "select r.i as b, (select count(*) from b where pref is not null)::double as battles from range(20) r(i)")
def bt_bootstrap_totals(spark: SparkSession, sf: str) -> DataFrame:
    """Each round draws as many battles as there are."""
    points = R.bootstrap_points(_battles(spark, sf), 20, 11)
    return points.groupBy("b").agg(F.round(F.sum(F.col("points_a") + F.col("points_b")), 6).alias("battles"))


@query(_B + "select model_a, model_b, count(*) as battles, true as near from b where pref is not null group by all")
def bt_bootstrap_means(spark: SparkSession, sf: str) -> DataFrame:
    """The mean points of a pair over the rounds lie within five standard deviations of those of its battles."""
    df, rounds = _battles(spark, sf), 20
    drawn = R.bootstrap_points(df, rounds, 11).groupBy("model_a", "model_b").agg((F.sum("points_a") / rounds).alias("a"), (F.sum("points_b") / rounds).alias("b"))
    both = R.sufficient_statistics(df).join(drawn, ["model_a", "model_b"], "left").na.fill(0.0, ["a", "b"])
    far = F.greatest(F.abs(F.col("a") - F.col("points_a")), F.abs(F.col("b") - F.col("points_b")))
    return both.select("model_a", "model_b", "battles", (far <= 5 * F.sqrt(F.col("battles") / rounds)).alias("near"))


@query()
def elo_mae_vs_human(spark: SparkSession, sf: str) -> DataFrame:
    human = V.view(spark, sf, V.HUMAN).select("model_a", "model_b", P.winner_preference(F.col("winner")).alias("pref"))
    both = _union(spark, sf)
    mean = R.leaderboard(R.bootstrap(both, 5, 3)).select("model", F.col("mean").alias("rating"))
    return R.mean_absolute_error(mean, R.ratings_frame(spark, R.fit_bradley_terry(human)), "m0")


_CAL = f"with j as ({_DJ}), c as (select {_score('judge_completion', 'a')} - {_score('judge_completion', 'b')} as delta, " \
    "cast(case user_id % 3 when 0 then 1 when 1 then 0 else 0.5 end as double) as y from (select j.*, e.user_id from j join events e using (event_id))) "


def _calibration(spark: SparkSession, sf: str) -> DataFrame:
    t = F.col("judge_completion")
    users = spark.read.parquet(f"{sf}/events.parquet").select("event_id", "user_id")
    y = F.when(F.col("user_id") % 3 == 0, 1.0).when(F.col("user_id") % 3 == 1, 0.0).otherwise(0.5)
    return _judged(spark, sf).join(users, "event_id").select((T.score_a(t) - T.score_b(t)).alias("delta"), y.alias("y"))


@query(_CAL + "select (2 * y - 1) * delta + 0.0 as z, count(*) as n from c where delta is not null and y <> 0.5::double group by 1")
def calibration_histogram(spark: SparkSession, sf: str) -> DataFrame:
    return C.agreement_histogram(_calibration(spark, sf)).withColumn("z", F.col("z") + F.lit(0.0))


@query()
def calibrated_temperature(spark: SparkSession, sf: str) -> DataFrame:
    return spark.createDataFrame([(C.calibrate_temperature(_calibration(spark, sf)),)], "temperature double")


@query(_CAL + "select count(*) as n, 0.0::double as slope from c where delta is not null and y <> 0.5::double")
def calibration_balance(spark: SparkSession, sf: str) -> DataFrame:
    """The slope of the likelihood at the calibrated temperature, a row's share of it, which a best fit makes zero."""
    df = _calibration(spark, sf)
    t = C.calibrate_temperature(df)
    z = F.col("z")
    slope = F.sum(F.col("n") * z / (1 + F.exp(t * z))) / F.sum("n")
    return C.agreement_histogram(df).agg(F.sum("n").alias("n"), (F.round(slope, 9) + F.lit(0.0)).alias("slope"))


# --- completions ------------------------------------------------------------------------------------------------------
@query(_OUT + ", " + _LAST + " select instruction_index, model, output from l")
def outputs_last_wins(spark: SparkSession, sf: str) -> DataFrame:
    return O.last_outputs(V.view(spark, sf, V.OUTPUTS))


@query(_OUT + ", " + _LAST + " select instruction_index, max(output) filter (where model = 'src1') as src1, max(output) filter (where model = 'src2') as src2 from l group by 1")
def outputs_pivot(spark: SparkSession, sf: str) -> DataFrame:
    return O.outputs_wide(V.view(spark, sf, V.OUTPUTS), ["src1", "src2"])


@query(_OUT + "select instruction_index, model, ord from (select *, row_number() over (partition by instruction_index order by ord) as r from o) where r = 1")
def first_wins_dedupe(spark: SparkSession, sf: str) -> DataFrame:
    return O.first_rows(V.view(spark, sf, V.OUTPUTS), "instruction_index", "ord").select("instruction_index", "model", "ord")


_INS = "i as (select distinct instruction_index from o)"


def _instructions(spark: SparkSession, sf: str) -> DataFrame:
    return V.view(spark, sf, V.OUTPUTS).select("instruction_index").distinct()


@query(
    _OUT + ", " + _LAST + ", " + _INS + " select instruction_index, a.output as completion_a, b.output as completion_b "
    "from i join (from l where model = 'src1') a using (instruction_index) join (from l where model = 'src2') b using (instruction_index)"
)
def completion_align_inner(spark: SparkSession, sf: str) -> DataFrame:
    out = V.view(spark, sf, V.OUTPUTS)
    return O.pair(_instructions(spark, sf), O.model_outputs(out, "src1"), O.model_outputs(out, "src2"), strict=False)


@query(_OUT + ", " + _INS + " select instruction_index from i where instruction_index not in (select instruction_index from o where model = 'src1' and lang = 'en')")
def missing_completions_anti(spark: SparkSession, sf: str) -> DataFrame:
    english = O.model_outputs(V.view(spark, sf, V.OUTPUTS).where("lang = 'en'"), "src1")
    return O.missing(_instructions(spark, sf), english)


@query(
    _OUT + ", " + _LAST + ", " + _INS + ", k as (select instruction_index, case instruction_index % 3 when 0 then 'src1' when 1 then 'src2' else 'src3' end as model_b from i) "
    "select k.instruction_index, k.model_b, l.output as completion_b from k join l on k.instruction_index = l.instruction_index and k.model_b = l.model"
)
def per_row_baseline(spark: SparkSession, sf: str) -> DataFrame:
    kind = T.fixed_map((F.col("instruction_index") % 3).cast("string"), {"0": "src1", "1": "src2"}, "src3")
    return O.per_row_baseline(_instructions(spark, sf).withColumn("model_b", kind), V.view(spark, sf, V.OUTPUTS))


@query(
    _OUT + ", " + _LAST + ", pre as (select instruction_index, output as completion from l where model = 'src1' and instruction_index % 2 = 0), "
    "gen as (select instruction_index, output as completion from l where model = 'src2') "
    "from pre union all from gen where instruction_index not in (select instruction_index from pre)"
)
def completion_fallback(spark: SparkSession, sf: str) -> DataFrame:
    out = V.view(spark, sf, V.OUTPUTS)
    return O.with_fallback(O.model_outputs(out, "src1").where("instruction_index % 2 = 0"), O.model_outputs(out, "src2"))


# --- conversations ----------------------------------------------------------------------------------------------------
_CONV = f"with c as ({V.CONVERSATIONS_DUCKDB}) "


@query(_CONV + "select conv_id, len(conversation) as messages, md5(list_aggregate([x.role || ':' || x.content for x in conversation], 'string_agg', chr(10))) as digest from c")
def conversation_nest(spark: SparkSession, sf: str) -> DataFrame:
    lines = F.array_join(F.transform("conversation", lambda x: F.concat(x["role"], F.lit(":"), x["content"])), "\n")
    return V.view(spark, sf, V.CONVERSATIONS).select("conv_id", F.size("conversation").cast("long").alias("messages"), F.md5(lines).alias("digest"))


@query(_CONV + "select conv_id from c where len(conversation) = 2")
def single_turn_filter(spark: SparkSession, sf: str) -> DataFrame:
    talk = F.col("conversation")
    raw = V.view(spark, sf, V.CONVERSATIONS).select(
        F.col("conv_id").alias("question_id"), F.lit(0).cast("long").alias("tstamp"), F.lit("m").alias("model_a"), F.lit("n").alias("model_b"),
        F.lit("tie").alias("winner"), talk.alias("conversation_a"), talk.alias("conversation_b"),
    )
    return finish(raw, "conversations", single_turn=True).select(F.col("question_id").cast("long").alias("conv_id"))


@query(_CONV + "select conv_id, conversation[1].content as first_text, conversation[2].content as second_text from c")
def first_user_text(spark: SparkSession, sf: str) -> DataFrame:
    c = F.col("conversation")
    return V.view(spark, sf, V.CONVERSATIONS).select("conv_id", T.message(c, 0).alias("first_text"), T.message(c, 1).alias("second_text"))


@query(
    "select conv_id, coalesce(string_agg(text, ' ' order by turn) filter (where turn % 2 = 0), '') as text from conversations where role <> 'system' group by conv_id"
)
def content_blocks_text(spark: SparkSession, sf: str) -> DataFrame:
    raw = spark.read.parquet(f"{sf}/conversations.parquet").where("role <> 'system'")
    block = F.struct("turn", F.when(F.col("turn") % 2 == 0, "text").otherwise("image").alias("type"), "text")
    return raw.groupBy("conv_id").agg(F.array_sort(F.collect_list(block)).alias("b")).select("conv_id", T.content_text(F.col("b")).alias("text"))


# --- two-turn benchmark -----------------------------------------------------------------------------------------------
_ITEMS = """, i as (
  select instruction_index, category, 1 as turn, case when category in ('math', 'reasoning', 'coding') then 'pair-math-v1' else 'pair-v2' end as prompt_name from q
  union all select instruction_index, category, 2, case when category in ('math', 'reasoning', 'coding') then 'pair-math-v1-multi-turn' else 'pair-v2-multi-turn' end
  from q where coalesce(turn_2, '') <> '')
"""


def _items(spark: SparkSession, sf: str) -> DataFrame:
    return TT.judge_items(V.view(spark, sf, V.QUESTIONS).select("instruction_index", "category", "turn_1", "turn_2"))


@query(_Q + _ITEMS + "select instruction_index, category, cast(turn as bigint) as turn, prompt_name from i")
def mtbench_items(spark: SparkSession, sf: str) -> DataFrame:
    return _items(spark, sf).select("instruction_index", "category", F.col("turn").cast("long").alias("turn"), "prompt_name")


_JUDGED_ITEMS = ", p as (select category, turn, cast(case (instruction_index + turn) % 4 when 0 then 0 when 1 then 1 when 2 then 0.5 end as double) as pref from i) "


@query(
    _Q + _ITEMS + _JUDGED_ITEMS + f"select '' as key, '' as value, {_SUMMARY} from p union all select 'category', category, {_SUMMARY} from p group by category "
    f"union all select 'turn', cast(turn as varchar), {_SUMMARY} from p group by turn"
)
def mtbench_judge_summary(spark: SparkSession, sf: str) -> DataFrame:
    k = (F.col("instruction_index") + F.col("turn")) % 4
    judged = _items(spark, sf).withColumn("pref", F.when(k == 0, 0.0).when(k == 1, 1.0).when(k == 2, 0.5))
    return _summary(S.pref_summary_each(judged, ["category", "turn"]), "key", "value")


@query(
    _Q + "select instruction_index, cast(case category when 'writing' then 0.7 when 'roleplay' then 0.7 when 'stem' then 0.1 when 'humanities' then 0.1 else 0 end as double) as temperature, "
    "category in ('math', 'reasoning', 'coding') as needs_reference from q"
)
def category_settings(spark: SparkSession, sf: str) -> DataFrame:
    c = F.col("category")
    return V.view(spark, sf, V.QUESTIONS).select("instruction_index", T.category_temperature(c).alias("temperature"), T.needs_reference(c).alias("needs_reference"))


# --- hashes and small functions ---------------------------------------------------------------------------------------
@query(r"""select sha256('[' || string_agg(j, ', ' order by md5('7~' || doc_id), doc_id) || ']') as fingerprint, count(*) as n from (
  select doc_id, '{"index": ' || doc_id || ', "model_a": "' || source || '", "model_b": "' || lang || '", "question_id": "' || doc_id || '"}' as j from documents order by md5('7~' || doc_id), doc_id limit 100)""")
def sample_fingerprint(spark: SparkSession, sf: str) -> DataFrame:
    from duelgrid.plans.repro import sample_fingerprint as fingerprint

    panel = B.seeded_sample(_docs(spark, sf).select("doc_id", "source", "lang"), 100, "doc_id", 7)
    place = F.struct(F.md5(F.concat_ws("~", F.lit("7"), F.col("doc_id")).cast("binary")), "doc_id")
    rows = panel.select(F.col("doc_id").alias("index"), F.col("doc_id").cast("string").alias("question_id"), F.col("source").alias("model_a"), F.col("lang").alias("model_b"), place.alias("place"))
    return fingerprint(rows, "place")


@query("""select sha256('[' || string_agg('"' || source || '"', ',' order by source) || ']') as digest, count(*) as n from (select distinct source from documents)""")
def index_set_hash(spark: SparkSession, sf: str) -> DataFrame:
    from duelgrid.plans.repro import set_hash

    return set_hash(_docs(spark, sf), "source")


@query(r"""select event_id, [try_cast(x as int) for x in string_split(regexp_replace(regexp_extract(t, '\[(.*?)\]', 1), '[^\d.,]', '', 'g'), ',') if regexp_full_match(x, '\d+')] as numbers
from (select event_id, 'criteria [' || event_id % 6 || ', x, ' || user_id % 10 || ' , 2.5] [9]' as t from events)""")
def criteria_list_parse(spark: SparkSession, sf: str) -> DataFrame:
    e = spark.read.parquet(f"{sf}/events.parquet")
    t = F.concat(F.lit("criteria ["), F.col("event_id") % 6, F.lit(", x, "), F.col("user_id") % 10, F.lit(" , 2.5] [9]"))
    return e.select("event_id", T.criteria_numbers(t).alias("numbers"))


@query("select p_partkey, coalesce(nullif(trim(regexp_replace(lower(p_name || ' / ' || p_type), '[^a-z0-9]+', '-', 'g'), '-'), ''), 'model') as slug from part")
def slugify(spark: SparkSession, sf: str) -> DataFrame:
    part = spark.read.parquet(f"{sf}/part.parquet")
    return part.select("p_partkey", T.slugify(F.concat("p_name", F.lit(" / "), "p_type")).alias("slug"))


@query("select p_partkey, split_part(s, '/', 1) as provider, case when instr(s, '/') > 0 then substr(s, instr(s, '/') + 1) else '' end as name from (select p_partkey, case when p_partkey % 3 = 0 then p_brand else p_brand || '/' || p_type || '/' || p_name end as s from part)")
def model_spec_split(spark: SparkSession, sf: str) -> DataFrame:
    part = spark.read.parquet(f"{sf}/part.parquet")
    s = F.when(F.col("p_partkey") % 3 == 0, F.col("p_brand")).otherwise(F.concat_ws("/", "p_brand", "p_type", "p_name"))
    return part.select("p_partkey", T.provider_of(s).alias("provider"), T.model_of(s).alias("name"))


@query(
    _OUT + ", " + _LAST + ", x as (select instruction_index, a.output as a, b.output as b from (from l where model = 'src1') a join (from l where model = 'src2') b using (instruction_index)), "
    "r as (select instruction_index, '<|User Prompt|>' || chr(10) || 'question ' || instruction_index || chr(10) || chr(10) || '<|The Start of Assistant A''s Answer|>' || chr(10) || left(a, 500) || chr(10) "
    "|| '<|The End of Assistant A''s Answer|>' || chr(10) || chr(10) || '<|The Start of Assistant B''s Answer|>' || chr(10) || left(b, 500) || chr(10) || '<|The End of Assistant B''s Answer|>' || chr(10) || chr(10) "
    "|| '# Your output' || chr(10) || 'score_A: <number from 0 to 10>' || chr(10) || 'score_B: <number from 0 to 10>' || chr(10) as p from x) "
    "select instruction_index, length(p) as n, md5(p) as digest from r"
)
def prompt_render_default(spark: SparkSession, sf: str) -> DataFrame:
    from duelgrid.plans.prompts import render_pair

    out = V.view(spark, sf, V.OUTPUTS)
    pairs = O.model_outputs(out, "src1").withColumnRenamed("completion", "a").join(O.model_outputs(out, "src2").withColumnRenamed("completion", "b"), "instruction_index")
    p = render_pair(F.concat(F.lit("question "), F.col("instruction_index")), F.col("a"), F.col("b"), limit=500)
    return pairs.select("instruction_index", F.length(p).cast("long").alias("n"), F.md5(p).alias("digest"))


@query(
    _Q + "select instruction_index, md5('[Question]' || chr(10) || turn_1 || case when category in ('math', 'reasoning', 'coding') then chr(10) || chr(10) || '[Reference Answer]' || chr(10) || coalesce(reference_turn_1, '') else '' end "
    "|| chr(10) || chr(10) || '[Assistant A]' || chr(10) || category || chr(10) || chr(10) || '[Assistant B]' || chr(10) || coalesce(turn_2, '') || chr(10)) as digest from q"
)
def prompt_render_mtbench(spark: SparkSession, sf: str) -> DataFrame:
    from duelgrid.plans.prompts import render_single_turn

    q = V.view(spark, sf, V.QUESTIONS)
    p = render_single_turn(F.col("turn_1"), F.col("category"), F.col("turn_2"), F.when(T.needs_reference(F.col("category")), F.coalesce("reference_turn_1", F.lit(""))))
    return q.select("instruction_index", F.md5(p).alias("digest"))
