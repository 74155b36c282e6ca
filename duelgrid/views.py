"""Evaluation-shaped inputs derived from the star-schema and text tables, in Spark SQL and in DuckDB's dialect."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

BATTLES = """
select l_orderkey, p_brand as model_a, m2 as model_b,
       cast(case when l_quantity > q2 then 0 when l_quantity < q2 then 1 else 0.5 end as double) as pref
from (select l_orderkey, p_brand, l_quantity, lead(p_brand) over w as m2, lead(l_quantity) over w as q2
      from lineitem join part on l_partkey = p_partkey
      window w as (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice)) t
where m2 is not null and m2 <> p_brand
"""

_JUDGED = """
select event_id, concat('m', cast(user_id % 8 as string)) as model,
  concat('m', cast((user_id + 1 + event_id % 7) % 8 as string)) as opponent,
  case when event_id % 2 = 0 then true else false end as pos_a,
  {a} as judge_completion, {b} as judge_completion_swapped
from events
"""
_TEXT = """case event_type
   when 'click'    then concat('score_A: ', cast({e} % 11 as string), chr(10), 'score_B: ', cast(({e} * 7) % 11 as string))
   when 'view'     then concat('<think>score_A: 1 score_B: 9</think>', chr(10), 'Score of Assistant A: ', cast(user_id % 11 as string),
                               chr(10), 'Score of Assistant B: ', cast({e} % 11 as string), ' [[B]]')
   when 'purchase' then 'Reasoning [[A]]'
   when 'signup'   then concat('stray reasoning</think> **Score_A**: ', cast({e} % 3 as string),
                               ' score_b "', cast(-(user_id % 5) as string), '" [[C]]')
   else 'no verdict' end"""
JUDGED = _JUDGED.format(a=_TEXT.format(e="event_id"), b=_TEXT.format(e="(event_id + 1)"))

CONVERSATIONS = """
select conv_id, transform(array_sort(collect_list(struct(turn, role, text))), x -> struct(x.role as role, x.text as content)) as conversation
from conversations where role <> 'system' group by conv_id
"""
CONVERSATIONS_DUCKDB = """
select conv_id, list({'role': role, 'content': text} order by turn) as conversation
from conversations where role <> 'system' group by conv_id
"""

QUESTIONS = """
select item_id as instruction_index,
  case item_id % 8 when 0 then 'writing' when 1 then 'roleplay' when 2 then 'extraction' when 3 then 'math'
       when 4 then 'coding' when 5 then 'reasoning' when 6 then 'stem' else 'humanities' end as category,
  text as turn_1, case when item_id % 5 = 0 then null else concat('follow-up: ', text) end as turn_2,
  case when item_id % 8 in (3, 4, 5) then concat('first: ', text) end as reference_turn_1,
  case when item_id % 8 in (3, 4, 5) then concat('second: ', text) end as reference_turn_2
from benchmark
"""

OUTPUTS = """
select cast(floor(doc_id / 40) as bigint) as instruction_index, source as model, text as output, lang, doc_id as ord from documents
"""

#: Neighbouring labelled documents of one language form a battle.
HUMAN = """
select doc_id as battle_id, source as model_a, s2 as model_b, lang,
  case when toxic = 1 and t2 = 1 then 'tie (bothbad)' when quality > q2 then 'model_a'
       when quality < q2 then 'model_b' else 'tie' end as winner
from (select documents.doc_id, source, lang, quality, toxic, lead(source) over w as s2,
             lead(quality) over w as q2, lead(toxic) over w as t2
      from documents join labels on documents.doc_id = labels.doc_id
      window w as (partition by cast(floor(documents.doc_id / 50) as bigint) order by documents.doc_id)) t
where s2 is not null and s2 <> source
"""

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "benchmark", "labels",
    "conversations",
)


def view(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """Run a view's text over the tables of sf_dir, which it names without aliases, leaving the session's catalog alone."""
    frames: dict[str, DataFrame] = {}

    def placed(m: re.Match) -> str:
        name = m[2]
        if name not in TABLES:
            return m[0]
        frames[name] = spark.read.parquet(f"{sf_dir}/{name}.parquet")
        return f"{m[1]} {{{name}}} {name}"

    return spark.sql(re.sub(r"\b(from|join) (\w+)\b", placed, sql), **frames)
