"""Registered queries over the readers' normalisers, baselines and two-turn tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from duelgrid import views as V
from duelgrid.functions import prefs as P
from duelgrid.functions import text as T
from duelgrid.operators import battles as B
from duelgrid.operators import completions
from duelgrid.operators import ratings as R
from duelgrid.operators import twoturn as TT
from duelgrid.plans import baselines, cache, criteria
from duelgrid.queries import _B, _H, _ITEMS, _OUT, _Q, _WINNER_PREF, query
from duelgrid.sources import arenas, language, tables
from duelgrid.sources.order import in_load_order


def _human_texts(spark: SparkSession, sf: str) -> DataFrame:
    """Human battles with the text of their document."""
    texts = spark.read.parquet(f"{sf}/documents.parquet").select(F.col("doc_id").alias("battle_id"), "text")
    return V.view(spark, sf, V.HUMAN).join(texts, "battle_id")


_RAW = f"with h as ({V.HUMAN}), r as (select h.*, text from h join documents d on h.battle_id = d.doc_id) "


def _part(side: str) -> Column:
    """The first half of a text, which has the middle character of an odd number, or the rest."""
    length = "length(text) div 2" if side == "right" else "length(text) - length(text) div 2"
    return F.expr(f"{side}(text, cast({length} as int))")


def _digest(text: Column, name: str) -> list[Column]:
    """A whole text by its length and md5."""
    return [F.length(text).cast("long").alias(f"{name}_n"), F.md5(text.cast("binary")).alias(name)]


def _half(text: str, name: str) -> str:
    rest = name.endswith(("b", "2"))
    half = f"{'right' if rest else 'left'}({text}, ({'' if rest else f'length({text}) - '}length({text}) // 2)::int)"
    return f"length({half})::bigint as {name}_n, md5({half}) as {name}"


@query(
    _RAW + "select battle_id::varchar as question_id, model_a, model_b, case when winner like 'tie%' then 'tie' else winner end as winner, "
    f"{_half('text', 'prompt')}, {_half('text', 'answer_b')}, 1::bigint as turns from r"
)
def arena_one_hot(spark: SparkSession, sf: str) -> DataFrame:
    raw = _human_texts(spark, sf)
    flag = lambda c: c.cast("int")
    raw = raw.select(
        F.col("battle_id").alias("id"), "model_a", "model_b", _part("left").alias("prompt"), F.lit("a").alias("response_a"),
        _part("right").alias("response_b"), flag(F.col("winner") == "model_a").alias("winner_model_a"),
        flag(F.col("winner") == "model_b").alias("winner_model_b"), flag(F.col("winner").startswith("tie")).alias("winner_tie"),
    )
    made = arenas.arena_55k(raw)
    prompt, answer = T.message(F.col("conversation_a"), 0), T.message(F.col("conversation_b"), 1)
    return made.select("question_id", "model_a", "model_b", "winner", *_digest(prompt, "prompt"), *_digest(answer, "answer_b"), F.col("turns").cast("long").alias("turns"))


@query(
    _RAW + "select battle_id::varchar as question_id, winner, battle_id + 1700000000 as tstamp, lower(lang) as lang, length(text)::bigint as first_text_n, md5(text) as first_text from r"
)
def arena_parquet_shape(spark: SparkSession, sf: str) -> DataFrame:
    block = F.array(F.struct(F.lit("text").alias("type"), F.col("text").alias("text")), F.struct(F.lit("image").alias("type"), F.lit("skip").alias("text")))
    talk = F.array(F.struct(F.lit("user").alias("role"), block.alias("content")), F.struct(F.lit("assistant").alias("role"), block.alias("content")))
    raw = _human_texts(spark, sf).select(
        F.col("battle_id").alias("id"), F.timestamp_seconds(F.col("battle_id") + 1700000000).alias("timestamp"), "model_a", "model_b",
        F.when(F.col("winner") == "tie (bothbad)", "both_bad").otherwise(F.col("winner")).alias("winner"),
        talk.alias("conversation_a"), talk.alias("conversation_b"), F.upper("lang").alias("language"),
    )
    made = arenas.arena_parquet(raw, "LMArena-140k", single_turn=True)
    return made.select("question_id", "winner", "tstamp", "lang", *_digest(T.message(F.col("conversation_a"), 0), "first_text"))


_CHOSEN = "case when battle_id % 7 = 0 then 'neither' when winner = 'model_a' then model_a else model_b end"


@query(
    _H + f"select battle_id::varchar as question_id, case when winner = 'tie' then 'tie' when {_CHOSEN} = model_a then 'model_a' else 'model_b' end as winner "
    f"from h where winner = 'tie' or {_CHOSEN} in (model_a, model_b)"
)
def arena_chosen_name(spark: SparkSession, sf: str) -> DataFrame:
    chosen = F.when(F.col("battle_id") % 7 == 0, "neither").when(F.col("winner") == "model_a", F.col("model_a")).otherwise(F.col("model_b"))
    empty = F.array().cast(arenas.CONVERSATION)
    raw = V.view(spark, sf, V.HUMAN).select(
        F.col("battle_id").alias("id"), F.lit(0).cast("long").alias("tstamp"), F.col("model_a").alias("model_a_name"), F.col("model_b").alias("model_b_name"),
        chosen.alias("chosen_model_name"), (F.col("winner") == "tie").alias("both_equal"), empty.alias("conversation_a"), empty.alias("conversation_b"),
    )
    return arenas.arena_comparia(raw).select("question_id", "winner")


@query(
    _OUT + "select instruction_index::varchar as instruction_index, text as instruction, lang from (select instruction_index, output as text, lang, "
    "row_number() over (partition by instruction_index order by ord) as r from o) where r = 1"
)
def instruction_table(spark: SparkSession, sf: str) -> DataFrame:
    raw = V.view(spark, sf, V.OUTPUTS).select(F.col("instruction_index").alias("question_id"), F.col("output").alias("prompt"), "lang", "ord")
    return tables.instructions(raw, "ord").select("instruction_index", "instruction", "lang")


_ANSWER = "case when doc_id % 4 = 0 then source else text end"


@query(
    f"select doc_id::varchar as instruction_index, source as model, length({_ANSWER})::bigint as output_n, md5({_ANSWER}) as output "
    "from documents where doc_id % 4 <> 3 and text <> '' and source is not null"
)
def model_output_table(spark: SparkSession, sf: str) -> DataFrame:
    """Flat outputs, plain last messages, last messages with an answer field, and rows without any."""
    d, k = spark.read.parquet(f"{sf}/documents.parquet"), F.col("doc_id") % 4
    nested = F.to_json(F.struct(F.col("text").alias("answer"), F.lit("why").alias("reasoning")))
    last = F.when(k == 1, F.col("text")).when(k == 2, nested)
    say = lambda role, c: F.struct(F.lit(role).alias("role"), c.alias("content"))
    raw = d.select(
        F.col("doc_id").alias("uid"), F.col("source").alias("model"), F.when(k == 0, F.col("source")).otherwise("").alias("output"),
        F.array(say("user", F.lit("q")), say("assistant", last)).alias("messages"),
    )
    return tables.model_outputs_long(raw).select("instruction_index", "model", *_digest(F.col("output"), "output"))


@query(
    _Q + "select q.instruction_index::varchar as instruction_index, q.turn_1, q.turn_2, case when q.instruction_index % 3 <> 0 then q.turn_1 end as reference_turn_1, "
    "case when q.instruction_index % 3 <> 0 then q.turn_2 end as reference_turn_2 from q"
)
def two_turn_question_table(spark: SparkSession, sf: str) -> DataFrame:
    """Questions meet another model's answers by id, though one side pads its ids with zeros."""
    q = V.view(spark, sf, V.QUESTIONS)
    questions = q.select(F.lpad(F.col("instruction_index").cast("string"), 6, "0").alias("question_id"), "category", F.array("turn_1", "turn_2").alias("turns"))
    refs = q.where("instruction_index % 3 <> 0").select(
        F.col("instruction_index").alias("question_id"), F.array(F.struct(F.array("turn_1", "turn_2").alias("turns"))).alias("choices")
    )
    return tables.two_turn_questions(questions, refs).select("instruction_index", "turn_1", "turn_2", "reference_turn_1", "reference_turn_2")


@query(_Q + "select instruction_index::varchar as instruction_index, turn_1 as completion_turn_1, coalesce(turn_2, '') as completion_turn_2 from q")
def two_turn_answer_table(spark: SparkSession, sf: str) -> DataFrame:
    q = V.view(spark, sf, V.QUESTIONS)
    turns = F.when(F.col("turn_2").isNull(), F.array("turn_1")).otherwise(F.array("turn_1", "turn_2"))
    return tables.two_turn_answers(q.select(F.col("instruction_index").alias("question_id"), F.array(F.struct(turns.alias("turns"))).alias("choices")))


@query(
    _Q + _ITEMS + ", s as (select i.*, q.turn_1 as a, coalesce(q.turn_2, 'none') as b, x.swapped from i join q using (instruction_index), (values (false), (true)) x(swapped)) "
    "select instruction_index, turn::bigint as turn, swapped, case when swapped then b else a end as completion_a_1, case when swapped then a else b end as completion_b_1 from s"
)
def swapped_judge_items(spark: SparkSession, sf: str) -> DataFrame:
    q = V.view(spark, sf, V.QUESTIONS)
    q = q.withColumns({"completion_a_1": F.col("turn_1"), "completion_b_1": F.coalesce("turn_2", F.lit("none"))})
    made = TT.swapped_items(TT.judge_items(q.select("instruction_index", "category", "turn_1", "turn_2", "completion_a_1", "completion_b_1")))
    return made.select("instruction_index", F.col("turn").cast("long").alias("turn"), "swapped", "completion_a_1", "completion_b_1")


_SCORED = (
    _Q + _ITEMS + ", s as (select i.*, x.swapped, (instruction_index * turn) % 11 as a, instruction_index % 7 as b from i, (values (false), (true)) x(swapped)), "
    "p as (select *, 1.0::double / (1.0::double + exp(0.3::double * (a - b))) as p from s), "
    "r as (select *, round(case when swapped then 1 - p else p end, 9) as pref from p) "
)


@query(
    _SCORED + ", e as (select '' as key, '' as value, pref from r union all select 'category', category, pref from r union all select 'turn', turn::varchar, pref from r) "
    "select key, value, count(*) as num_battles, count(*) filter (where pref < 0.5::double) as num_wins, count(*) filter (where pref > 0.5::double) as num_losses, "
    "count(*) filter (where pref = 0.5::double) as num_ties from e group by all"
)
def two_turn_scored_summary(spark: SparkSession, sf: str) -> DataFrame:
    """Two-turn items judged by scores in both orders: two results an item, overall, by category and by turn."""
    from duelgrid.operators.summary import pref_summary_each
    from duelgrid.plans.pipelines import with_scores

    items = TT.swapped_items(TT.judge_items(V.view(spark, sf, V.QUESTIONS).select("instruction_index", "category", "turn_1", "turn_2")))
    told = F.concat(F.lit("score_A: "), (F.col("instruction_index") * F.col("turn")) % 11, F.lit(" score_B: "), F.col("instruction_index") % 7)
    scored = with_scores(items.withColumn("judge_completion", told)).withColumn("pref", F.round("pref", 9))
    return pref_summary_each(scored, ["category", "turn"]).select("key", "value", "num_battles", "num_wins", "num_losses", "num_ties")


@query(
    _Q + _ITEMS + "select instruction_index, turn::bigint as turn, w as winner, case w when 'model_a' then 0.0::double when 'model_b' then 1.0::double when 'tie' then 0.5::double end as pref, "
    "false as inconsistent from (select *, case (instruction_index + turn) % 4 when 0 then 'model_a' when 1 then 'model_b' when 2 then 'tie' else 'error' end as w from i)"
)
def two_turn_fixed_order(spark: SparkSession, sf: str) -> DataFrame:
    """Two-turn items judged by verdicts in one order only."""
    items = TT.judge_items(V.view(spark, sf, V.QUESTIONS).select("instruction_index", "category", "turn_1", "turn_2"))
    k = (F.col("instruction_index") + F.col("turn")) % 4
    said = F.when(k == 0, "so [[A]]").when(k == 1, "<think>[[A]]</think>[[B]]").when(k == 2, "[[C]]").otherwise("none")
    made = TT.resolve_one(items.withColumn("judge_completion", said))
    return made.select("instruction_index", F.col("turn").cast("long").alias("turn"), "winner", "pref", "inconsistent")


@query(
    "select doc_id, length(ltrim(a, chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' '))::bigint as n, md5(ltrim(a, chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' ')) as answer, "
    "true as had_thinking from (select doc_id, coalesce(text, '') as a from documents)"
)
def forced_end_strip(spark: SparkSession, sf: str) -> DataFrame:
    """Reasoning that an engine ended by force, in front of each whole text."""
    said = F.concat(F.lit("thoughts without a mark. " + T.FORCED_END + "\n"), F.coalesce("text", F.lit("")))
    d = spark.read.parquet(f"{sf}/documents.parquet")
    return d.select("doc_id", F.length(T.strip_thinking(said)).cast("long").alias("n"), F.md5(T.strip_thinking(said).cast("binary")).alias("answer"), T.had_thinking(said).alias("had_thinking"))


@query(
    "select doc_id, length(p)::bigint as n, md5(p) as digest from (select doc_id, 'Q: ' || coalesce(source, '') || ' | ' || left(coalesce(text, ''), 8192) || ' | ' || left(coalesce(lang, ''), 8192) || ' -> ' "
    "|| 'explanation: <a short comparison>' || chr(10) || 'score_A: <number from 0 to 10>' || chr(10) || 'score_B: <number from 0 to 10>' || chr(10) as p from documents)"
)
def prompt_render_file_template(spark: SparkSession, sf: str) -> DataFrame:
    """A template of the user's own, with an explanation asked for, at the default length."""
    from duelgrid.plans.prompts import render_pair

    template = "Q: {user_prompt} | {completion_A} | {completion_B} -> {output}"
    p = render_pair(F.col("source"), F.col("text"), F.col("lang"), 8192, template, explain=True)
    return spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", F.length(p).cast("long").alias("n"), F.md5(p.cast("binary")).alias("digest"))


@query("select doc_id::varchar as instruction_index, coalesce(text, '') as completion from documents where doc_id % 2 = 0 union all select doc_id::varchar, coalesce(source, '') || ' says ' from documents where doc_id % 2 <> 0")
def completions_where_lacking(spark: SparkSession, sf: str) -> DataFrame:
    """Given completions of half the instructions, and a model's answers to the other half."""
    from duelgrid.operators.completions import with_fallback

    d = spark.read.parquet(f"{sf}/documents.parquet").select(F.col("doc_id").cast("string").alias("instruction_index"), F.coalesce("text", F.lit("")).alias("completion"), "source", "doc_id")
    given = d.where("doc_id % 2 = 0").select("instruction_index", "completion")
    asked = d.select("instruction_index", F.concat(F.coalesce("source", F.lit("")), F.lit(" says ")).alias("completion"))
    return with_fallback(given, asked)


@query(
    "select doc_id as instruction_index, case doc_id % 4 when 3 then 'gemini-2.0-flash-001' else 'o3-mini-2025-01-31' end as model_b from documents"
)
def baseline_by_category(spark: SparkSession, sf: str) -> DataFrame:
    names = {"0": "hard_prompt", "1": "coding", "2": "math", "3": "creative_writing"}
    d = spark.read.parquet(f"{sf}/documents.parquet").select(F.col("doc_id").alias("instruction_index"), T.fixed_map((F.col("doc_id") % 4).cast("string"), names).alias("category"))
    return baselines.with_baseline(d, "arena-hard-v2.0").select("instruction_index", "model_b")


@query("select string_agg(source, '+' order by source) as baselines, count(*) = 1 as flat from (select distinct source from documents)")
def distinct_baselines(spark: SparkSession, sf: str) -> DataFrame:
    return baselines.distinct_baselines(spark.read.parquet(f"{sf}/documents.parquet").select(F.col("source").alias("model_b")))


@query(_B + "select model_a, model_b, pref, count(*) as battles from b group by all")
def battle_cells(spark: SparkSession, sf: str) -> DataFrame:
    return R.cells(V.view(spark, sf, V.BATTLES))


@query("select doc_id, doc_id || '-' || lang as instruction_index from documents where lang in ('cs', 'de', 'el', 'en', 'es', 'fr', 'it', 'nl', 'pl', 'pt', 'ro', 'uk') and lang <> 'en'")
def multilingual_keys(spark: SparkSession, sf: str) -> DataFrame:
    _, langs = baselines.split_multilingual("m-arena-hard-v2.0-EU")
    d = B.languages(spark.read.parquet(f"{sf}/documents.parquet"), [x for x in langs if x != "en"])
    return d.select("doc_id", T.composite_key(F.col("doc_id").cast("string"), F.col("lang")).alias("instruction_index"))


@query(
    "select p_partkey, case when m like '%qwen3%' then 'qwen3' when m like '%smollm3%' then 'qwen3' end as parser from "
    "(select p_partkey, lower(case p_partkey % 3 when 0 then 'Org/Qwen3-' || p_size when 1 then 'SmolLM3 ' || p_brand else p_name end) as m from part)"
)
def reasoning_parsers(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("p_partkey") % 3
    m = F.when(k == 0, F.concat(F.lit("Org/Qwen3-"), "p_size")).when(k == 1, F.concat(F.lit("SmolLM3 "), "p_brand")).otherwise(F.col("p_name"))
    return spark.read.parquet(f"{sf}/part.parquet").select("p_partkey", T.reasoning_parser(m).alias("parser"))


@query("select event_id, [0.0::double, coalesce(case when event_id % 2 = 0 then value end, 0.0), 0.0, 0.0, 0.0, 0.0] as scores from events")
def criteria_scores(spark: SparkSession, sf: str) -> DataFrame:
    given = F.when(F.col("event_id") % 2 == 0, F.create_map(F.lit("helpfulness"), F.col("value"))).otherwise(F.create_map().cast("map<string,double>"))
    return spark.read.parquet(f"{sf}/events.parquet").select("event_id", criteria.scores_in_order(given, list(criteria.DEFAULT)).alias("scores"))


@query(
    _H + f"select lang, count(*) as num_battles, round(avg({_WINNER_PREF.format(w='winner')}), 9) as mean_pref from h where lang is not null group by lang"
)
def human_prefs_by_language(spark: SparkSession, sf: str) -> DataFrame:
    df = V.view(spark, sf, V.HUMAN).where("lang is not null").withColumn("pref", P.winner_preference(F.col("winner")))
    return df.groupBy("lang").agg(F.count("*").alias("num_battles"), F.round(F.avg("pref"), 9).alias("mean_pref"))


def _words_sql(text: str) -> str:
    """The language that function_words() gives, as an expression over n_xx, hits of each language's words."""
    order = list(language.WORDS)
    best = f"greatest({', '.join(f'n_{k}' for k in order)})"
    scripts = " ".join(f"when regexp_matches({text}, '[{letters}]') then '{k}'" for k, letters in language.SCRIPTS.items())
    return f"case when {best} = 0 then case {scripts} else '{language.UNKNOWN}' end {' '.join(f"when n_{k} = {best} then '{k}'" for k in order)} end"


def _hits_sql() -> str:
    quoted = lambda words: ", ".join(f"'{w}'" for w in words)
    return ", ".join(f"len(list_filter(w, lambda x: x in ({quoted(words)}))) as n_{k}" for k, words in language.WORDS.items())


_DETECTED = (
    f"t as (select doc_id, lang as given, coalesce(text, '') as text, regexp_extract_all(lower(coalesce(text, '')), '[{language.LATIN}]+') as w from documents), "
    f"n as (select *, {_hits_sql()} from t), d as (select *, {_words_sql('text')} as told from n) "
)


def _talk(text: Column) -> Column:
    return F.array(F.struct(F.lit("user").alias("role"), text.alias("content")), F.struct(F.lit("assistant").alias("role"), F.lit("a").alias("content")))


def _arena_shapes(spark: SparkSession, sf: str) -> DataFrame:
    """Each document as a battle in one of the four shapes; two of them come without languages."""
    d = spark.read.parquet(f"{sf}/documents.parquet").withColumn("text", F.coalesce("text", F.lit("")))
    shape = lambda k: d.where(F.col("doc_id") % 4 == k)
    named = [F.lit("m").alias("model_a"), F.lit("n").alias("model_b")]
    hot = [F.lit(k).alias(c) for k, c in ((1, "winner_model_a"), (0, "winner_model_b"), (0, "winner_tie"))]
    one = arenas.arena_55k(shape(0).select(F.col("doc_id").alias("id"), *named, *hot, F.col("text").alias("prompt"), F.lit("a").alias("response_a"), F.lit("b").alias("response_b")))
    flat = lambda k, lang: shape(k).select(
        F.col("doc_id").alias("question_id"), F.lit(1).cast("long").alias("tstamp"), *named, F.lit("tie").alias("winner"),
        _talk(F.col("text")).alias("conversation_a"), _talk(F.col("text")).alias("conversation_b"), F.upper("lang").alias(lang),
    )
    chosen = shape(3).select(
        F.col("doc_id").alias("id"), F.lit(1).cast("long").alias("tstamp"), F.lit("m").alias("model_a_name"), F.lit("n").alias("model_b_name"), F.lit("m").alias("chosen_model_name"),
        F.lit(False).alias("both_equal"), _talk(F.col("text")).alias("conversation_a"), _talk(F.col("text")).alias("conversation_b"),
    )
    hundred, more = arenas.arena_parquet(flat(1, "language"), "LMArena-100k"), arenas.arena_parquet(flat(2, "lang"), "LMArena-140k")
    return one.unionByName(hundred).unionByName(more).unionByName(arenas.arena_comparia(chosen))


@query(
    f"with {_DETECTED} select doc_id::varchar as question_id, case doc_id % 4 when 0 then 'LMArena-55k' when 1 then 'LMArena-100k' when 2 then 'LMArena-140k' else 'ComparIA' end as benchmark, "
    "case when doc_id % 4 in (1, 2) and given is not null then lower(given) else told end as lang from d"
)
def arena_languages(spark: SparkSession, sf: str) -> DataFrame:
    """Languages of battles of all four shapes: those that are there, and a detector's where a shape or a row has none."""
    return arenas.with_language(_arena_shapes(spark, sf)).select("question_id", "benchmark", "lang")


@query(
    f"with {_DETECTED}, l as (select doc_id, case when doc_id % 4 in (1, 2) and given is not null then lower(given) else told end as lang from d), "
    "r as (select *, row_number() over (partition by lang order by doc_id) as r from l where lang in ('en', 'fr', 'de', 'es')) "
    "select doc_id::varchar as question_id, lang from r where r <= 30 order by doc_id limit 70"
)
def arena_panel(spark: SparkSession, sf: str) -> DataFrame:
    """The panel of a rating run: asked languages, the first of each in load order, and of those the first in all."""
    found = arenas.with_language(_arena_shapes(spark, sf).withColumn("ord", F.col("question_id").cast("long")))
    asked = B.languages(found, ["en", "fr", "de", "es"], strict=True)
    return B.panel(asked, None, 70, 30, "question_id", "ord").select("question_id", "lang")


def _row_sql(*columns: str) -> str:
    told = [f"'{len(c)}:{c}=' || coalesce(length({c}::varchar) || ':' || {c}::varchar, '-')" for c in sorted(columns)]
    return " || ';' || ".join(told)


@query(
    f"select count(*) as n, sum(h1)::varchar as total_1, sum(h2)::varchar as total_2, bit_xor(h1) as mixed_1, bit_xor(h2) as mixed_2 from (select ('0x' || substr(m, 1, 15))::bigint as h1, "
    f"('0x' || substr(m, 17, 15))::bigint as h2 from (select md5({_row_sql('doc_id', 'text', 'lang', 'source', 'n_chars')}) as m from documents))"
)
def content_digest(spark: SparkSession, sf: str) -> DataFrame:
    """What a cache knows a table by: its rows, in any order."""
    d = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars")
    return cache.table_digest(d)


@query(
    "select l_suppkey, l_orderkey, l_linenumber from (select *, row_number() over (partition by l_suppkey order by n) as r "
    "from (select *, row_number() over () as n from lineitem)) where r = 1"
)
def first_in_file_order(spark: SparkSession, sf: str) -> DataFrame:
    """The row of each supplier that stands first in the file, which is not sorted by it."""
    lines = in_load_order(spark.read.parquet(f"{sf}/lineitem.parquet").select("l_suppkey", "l_orderkey", "l_linenumber"))
    return completions.first_rows(lines, "l_suppkey", "ord").select("l_suppkey", "l_orderkey", "l_linenumber")


@query(
    "select doc_id, lang from (select doc_id, lang, row_number() over (partition by lang order by n) as r, n "
    "from (select *, row_number() over () as n from documents)) where r <= 40 order by n limit 120"
)
def panel_in_file_order(spark: SparkSession, sf: str) -> DataFrame:
    """The first rows of each language, and of those the first in all, as they stand in the file."""
    d = in_load_order(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang"))
    return B.panel(d, None, 120, 40, "doc_id", "ord").select("doc_id", "lang")
