"""Queries over texts: parsing, canonical records, answers, grading."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import answers as A
from ..functions import text as T
from ..operators import corpus, rollouts
from . import inputs, oracle as O
from .registry import query


def _join(column, separator: str = "|") -> Column:
    return F.array_join(column, separator)


# Parsing ---------------------------------------------------------------------


@query(
    """select o_orderkey as id, case o_orderkey % 4 when 0 then o_orderkey || '|' || (o_orderkey + 1) when 1 then '[' || o_orderkey || ', 9)'
      when 2 then '[' || o_orderkey || ',1]' else cast(o_orderkey as varchar) end as targets, case when o_orderkey % 4 = 0 then 2 else 1 end as n
    from orders"""
)
def mixed_target(spark, sf_dir):
    """Targets of records that hold a list, a text that looks like one, a plain text or a number."""
    i = F.col("o_orderkey")
    record = (
        F.when(i % 4 == 0, F.concat(F.lit('["'), i, F.lit('","'), i + 1, F.lit('"]')))
        .when(i % 4 == 1, F.concat(F.lit('"['), i, F.lit(', 9)"')))
        .when(i % 4 == 2, F.concat(F.lit('"['), i, F.lit(',1]"')))
        .otherwise(i.cast("string"))
    )
    parsed = inputs.table(spark, sf_dir, "orders").select(i.alias("id"), A.target_array(F.parse_json(record)).alias("t"))
    return parsed.select("id", _join("t").alias("targets"), F.size("t").alias("n"))


@query(
    """select event_id, cast(props ->> '$.k' as bigint) as k, '{"event_id":' || event_id || ',"k":' || (props ->> '$.k') || '}' as record
    from events"""
)
def event_records(spark, sf_dir):
    """JSON records parsed under a fixed schema and written again."""
    props = F.from_json("props", "k bigint", {"mode": "FAILFAST"})
    parsed = inputs.table(spark, sf_dir, "events").select("event_id", props["k"].alias("k"))
    return parsed.select("event_id", "k", F.to_json(F.struct("event_id", "k")).alias("record"))


# Corpus ----------------------------------------------------------------------

_STEPS_SQL = f"""
parsed0 as (select *, case when contains(answer, '####') then regexp_extract(answer, '(?s)\\A(.*)####(.*)\\z', 1) else answer end as body,
   case when contains(answer, '####') then {O.strip("regexp_extract(answer, '(?s)\\A(.*)####(.*)\\z', 2)")} else '' end as final from qa),
parsed as (select id, question, answer as raw, final,
   list_filter(list_transform(regexp_split_to_array({O.strip('body')}, {O.quoted(O.K.LINE_END)}), lambda s: {O.strip('s')}), lambda s: s <> '') as steps
   from parsed0)
"""

_CANONICAL_SQL = f"""{_STEPS_SQL},
canonical as (select id, {O.strip('question')} as input,
   array_to_string(case when final <> '' then list_append(steps, '#### ' || final) else steps end, chr(10)) as output,
   final as answer, case when final <> '' then [final] else [] end as solutions from parsed)
"""


def _parsed(spark, sf_dir) -> DataFrame:
    return corpus.split_answer(inputs.qa(spark, sf_dir))


@query(f"with {O.QA}, {_STEPS_SQL} select id, {O.joined('steps', '|')} as steps, final as answer from parsed")
def split_answer(spark, sf_dir):
    """Steps and final answer of every problem."""
    return _parsed(spark, sf_dir).select("id", _join("steps").alias("steps"), "answer")


@query(f"with {O.QA}, {_CANONICAL_SQL} select id, output from canonical")
def reasoning_text(spark, sf_dir):
    """Reasoning text rebuilt from steps and answer."""
    return _parsed(spark, sf_dir).select("id", corpus.reasoning_text("steps", "answer").alias("output"))


@query(f"with {O.QA}, {_CANONICAL_SQL} select id, input, output, answer, {O.joined('solutions', '|')} as solutions from canonical")
def canonical_stepwise(spark, sf_dir):
    """Canonical records from stepwise problems."""
    df = corpus.canonical_stepwise(_parsed(spark, sf_dir).drop("n"))
    return df.select("id", "input", "output", "answer", _join("solutions").alias("solutions"))


@query(
    f"""with {O.RESPONSES},
    r as (select *, {O.extract_answer('output')} as answer from (
        select example_id, rollout_id, {O.strip('question')} as input, {O.strip('final_text')} as output from responses))
    select example_id, rollout_id, input, output, answer, answer as solutions from r"""
)
def canonical_response(spark, sf_dir):
    """Canonical records from query/response pairs."""
    pairs = inputs.responses(spark, sf_dir).select(
        "example_id", "rollout_id", F.col("question").alias("query"), F.col("final_text").alias("response")
    )
    df = corpus.canonical_response(pairs)
    return df.select("example_id", "rollout_id", "input", "output", "answer", _join("solutions").alias("solutions"))


_COMPLEXITY_SQL = f"""complexity as (select id, len(steps) as n_steps,
   len(regexp_extract_all({O.joined('steps', chr(10))}, {O.quoted(O.K.ARITHMETIC_MARK)})) as n_marks,
   len(list_filter(regexp_split_to_array({O.joined('steps', chr(10))}, {O.quoted(O.K.WHITESPACE_CLASS + '+')}), lambda w: w <> '')) as n_tokens
   from parsed)"""


@query(f"with {O.QA}, {_STEPS_SQL}, {_COMPLEXITY_SQL} select * from complexity")
def answer_complexity(spark, sf_dir):
    """Step, annotation and token counts."""
    return corpus.with_complexity(_parsed(spark, sf_dir)).select("id", "n_steps", "n_marks", "n_tokens")


@query(
    f"""with {O.QA}, {_STEPS_SQL}, {_COMPLEXITY_SQL}
    select * from complexity order by n_steps desc, n_marks desc, n_tokens desc, id limit 500"""
)
def hard_topk(spark, sf_dir):
    """The 500 hardest problems."""
    from ..operators.splits import hardest

    measured = corpus.with_complexity(_parsed(spark, sf_dir)).select("id", "n_steps", "n_marks", "n_tokens")
    return hardest(measured, ["n_steps", "n_marks", "n_tokens"], "id", 500)


@query(
    f"""with {O.QA}, {_CANONICAL_SQL}
    select c.id, array_to_string(case when id % 3 = 0 and len(solutions) > 0 then solutions
         when id % 3 < 2 and c.answer <> '' then [c.answer] else [c.output] end, '|') as target from canonical c"""
)
def target_coalesce(spark, sf_dir):
    """First non-empty of solutions, answer, output where some records miss each."""
    df = corpus.canonical_stepwise(_parsed(spark, sf_dir))
    gaps = df.select(
        "id",
        F.when(F.col("id") % 3 == 0, F.col("solutions")).alias("solutions"),
        F.when(F.col("id") % 3 < 2, F.col("answer")).otherwise(F.lit("")).alias("answer"),
        "output",
    )
    return gaps.select("id", _join(corpus.first_target()).alias("target"))


@query(
    f"""with {O.QA}, {_CANONICAL_SQL}
    select id, case when id % 3 = 0 then 'ready ' || id else input || chr(10) || case when id % 5 = 0 then '' else output end end as text,
       case when id % 2 = 0 then input when id % 7 = 0 then '' else 'q' || id end as question from canonical"""
)
def fallbacks(spark, sf_dir):
    """Prepared or rebuilt text, and the question under either name."""
    df = corpus.canonical_stepwise(_parsed(spark, sf_dir))
    i = F.col("id")
    gaps = df.select(
        "id",
        "input",
        F.when(i % 3 == 0, F.concat(F.lit("ready "), i.cast("string"))).when(i % 3 == 1, F.lit("")).alias("reasoning_text"),
        F.when(i % 5 != 0, F.col("output")).alias("output"),
        F.when(i % 2 == 0, F.col("input")).when(i % 3 == 1, F.lit("")).alias("named_input"),
        F.when(i % 7 != 0, F.concat(F.lit("q"), i.cast("string"))).alias("question"),
    )
    return gaps.select(
        "id",
        corpus.text_or_built().alias("text"),
        corpus.question_or_empty("named_input", "question").alias("question"),
    )


@query(
    f"""with {O.PAIRS} select conv_id, turn, input || chr(10) as input_prompt, input || chr(10) || output as reasoning_text,
        cast(null as varchar) as train_solutions, output as eval_solutions from pairs"""
)
def prompt_columns(spark, sf_dir):
    """Prompt, full text and gold solutions, for training and evaluation."""
    pairs = inputs.pairs(spark, sf_dir).withColumn("solutions", F.array("output"))
    train = corpus.prompt_columns(pairs, train=True).withColumnRenamed("gt_solutions", "train_solutions")
    both = corpus.prompt_columns(train, train=False)
    return both.select(
        "conv_id",
        "turn",
        "input_prompt",
        "reasoning_text",
        _join("train_solutions").alias("train_solutions"),
        _join("gt_solutions").alias("eval_solutions"),
    )


@query(
    f"""with {O.PAIRS} select conv_id, turn, input as question, output as chain_of_thought, output as cot_only,
        input || chr(10) || output as full_format from pairs"""
)
def vae_view(spark, sf_dir):
    """Question, chain of thought and both input variants."""
    return corpus.vae_view(inputs.pairs(spark, sf_dir))


@query(
    f"""with {O.PAIRS} select conv_id, turn, 'cot_only' as variant, output as text from pairs
        union all select conv_id, turn, 'full_format', input || chr(10) || output from pairs"""
)
def input_variant(spark, sf_dir):
    """The text column of each input variant."""
    view = corpus.vae_view(inputs.pairs(spark, sf_dir))
    parts = [
        corpus.input_variant(view, v).select("conv_id", "turn", F.lit(v).alias("variant"), "text")
        for v in corpus.INPUT_VARIANTS
    ]
    return parts[0].unionByName(parts[1])


@query(
    f"""with {O.QA}, l as (select id, unnest(regexp_split_to_array(answer, chr(10))) as line from qa)
    select id, count(*) as kept from l where {O.strip('line')} <> '' group by id"""
)
def blank_filter(spark, sf_dir):
    """Non-blank lines per problem."""
    lines = inputs.qa(spark, sf_dir).select("id", F.explode(F.split("answer", "\n")).alias("line"))
    return corpus.drop_blank(lines, "line").groupBy("id").agg(F.count(F.lit(1)).alias("kept"))


# Text functions --------------------------------------------------------------


@query(f"with {O.TEXTS} select text_id, md5({O.strip('text')}) as stripped, length({O.strip('text')}) as size from texts")
def strip_text(spark, sf_dir):
    """Digest and length of every stripped text."""
    df = inputs.texts(spark, sf_dir).withColumn("s", T.strip("text"))
    return df.select("text_id", F.md5(F.col("s").cast("binary")).alias("stripped"), F.length("s").alias("size"))


@query(
    f"""with {O.TEXTS} select text_id,
      {O.strip(f"regexp_split_to_array({O.strip('text')}, {O.quoted(O.K.LINE_END)})[-1]")} as line from texts"""
)
def last_line(spark, sf_dir):
    """Last line of every text."""
    return inputs.texts(spark, sf_dir).select("text_id", T.last_line(T.strip("text")).alias("line"))


@query(
    f"""with {O.TEXTS} select text_id, md5({O.clean_answer("' $ :' || text || '$ '")}) as cleaned from texts"""
)
def clean_answer(spark, sf_dir):
    """Digest of every cleaned text."""
    dressed = F.concat(F.lit(" $ :"), F.col("text"), F.lit("$ "))
    return inputs.texts(spark, sf_dir).select(
        "text_id", F.md5(A.clean_answer(dressed).cast("binary")).alias("cleaned")
    )


@query(f"with {O.TEXTS} select text_id, {O.extract_answer('text')} as answer from texts")
def extract_answer(spark, sf_dir):
    """Boxed or stated answer of every text."""
    return inputs.texts(spark, sf_dir).select("text_id", A.extract_answer("text").alias("answer"))


@query(f"with {O.TEXTS} select text_id, md5({O.strip_latex('text')}) as plain from texts")
def strip_latex(spark, sf_dir):
    """Digest of every text without LaTeX commands."""
    return inputs.texts(spark, sf_dir).select("text_id", F.md5(A.strip_latex("text").cast("binary")).alias("plain"))


@query(f"with {O.TEXTS} select text_id, {O.joined(f'regexp_extract_all(text, {O.NUMBER})', '|')} as numbers from texts")
def number_tokens(spark, sf_dir):
    """All number tokens of every text."""
    return inputs.texts(spark, sf_dir).select("text_id", _join(A.number_tokens("text")).alias("numbers"))


@query(f"with {O.TEXTS} select text_id, final as final_answer from ({O.final_answer('texts', 'text')})")
def final_answer(spark, sf_dir):
    """Final answer of every text."""
    return inputs.texts(spark, sf_dir).select("text_id", A.extract_final_answer("text").alias("final_answer"))


@query(
    f"""with {O.TEXTS}, n as (select text_id, unnest(regexp_extract_all(text, {O.NUMBER})) as token from texts),
    v as ({O.numbered('n', 'token')})
    select text_id, count(*) as tokens, count(number) as numbers, max(number) as largest, min(number) as smallest
    from v group by text_id"""
)
def to_number(spark, sf_dir):
    """Numeric values of all number tokens, summarised per text."""
    tokens = inputs.texts(spark, sf_dir).select("text_id", F.explode(A.number_tokens("text")).alias("token"))
    valued = tokens.select("text_id", A.to_number("token").alias("value"))
    return valued.groupBy("text_id").agg(
        F.count(F.lit(1)).alias("tokens"),
        F.count("value").alias("numbers"),
        F.max("value").alias("largest"),
        F.min("value").alias("smallest"),
    )


@query(f"with {O.TEXTS} select text_id, normal as normalized from ({O.normalized('texts', 'text')})")
def normalize_answer(spark, sf_dir):
    """Normalized answer of every text."""
    return inputs.texts(spark, sf_dir).select("text_id", A.normalize_answer("text").alias("normalized"))


# Grading ---------------------------------------------------------------------

_GRADED_SQL = f"""{O.RESPONSES},
graded as (select p.example_id, p.rollout_id, p.final_text, p.target, p.question,
     case when p.normal = g.normal or abs(p.normal_number - g.normal_number) <= 1e-6 then 1.0::double else 0.0::double end as label
   from ({O.normalized('responses', 'final_text')}) p
   join ({O.normalized('(select id as gold_id, cast(n as varchar) as gold_text from qa)', 'gold_text')}) g
   on p.example_id = g.gold_id)
"""


def graded(spark, sf_dir) -> DataFrame:
    """Responses graded against their problem's targets, normalized once per problem."""
    responses = inputs.responses(spark, sf_dir)
    examples = inputs.qa(spark, sf_dir).select(
        F.col("id").alias("example_id"),
        F.array(F.lit(None).cast("string"), F.col("n").cast("string")).alias("target"),
    )
    return rollouts.grade_against(responses, examples.withColumnRenamed("target", "gold_text"), targets="gold_text")


@query(f"with {_GRADED_SQL} select example_id, rollout_id, label from graded")
def grade_rollouts(spark, sf_dir):
    """Label of every rollout."""
    return graded(spark, sf_dir).select("example_id", "rollout_id", "label")


@query(f"with {_GRADED_SQL} select example_id, avg(label) as accuracy, max(label) as solved from graded group by example_id")
def accuracy_by_example(spark, sf_dir):
    """Share of right rollouts per problem, and whether any is right."""
    return graded(spark, sf_dir).groupBy("example_id").agg(
        F.avg("label").alias("accuracy"), F.max("label").alias("solved")
    )


@query(
    f"""with {_GRADED_SQL}, scored as (select *, round({O.draw('b', 'example_id', 'rollout_id')}, 1) as reward from graded)
    select example_id, rollout_id, reward, label from scored
    qualify row_number() over (partition by example_id order by reward desc, rollout_id) = 1"""
)
def best_of_n(spark, sf_dir):
    """Best-scored rollout per problem and whether it is right."""
    reward = F.round(T.uniform("b", "example_id", "rollout_id"), 1)
    scored = graded(spark, sf_dir).withColumn("reward", reward)
    return rollouts.best_of_n(scored).select("example_id", "rollout_id", "reward", "label")


@query(
    f"""with {_GRADED_SQL}
    select example_id, true as is_gt, cast(null as double) as timestep, answer as text, 1.0::double as reward, 1.0::double as lst_reward
      from (select id as example_id, cast(n as varchar) as answer from qa)
    union all select example_id, false, 0.0::double, final_text, label, label from graded"""
)
def gt_union(spark, sf_dir):
    """Rollout log with one ground-truth row per problem."""
    log = graded(spark, sf_dir).select(
        "example_id",
        F.lit(0.0).alias("timestep"),
        F.col("final_text").alias("text"),
        F.col("label").alias("reward"),
        F.col("label").alias("lst_reward"),
    )
    truth = inputs.qa(spark, sf_dir).select(
        F.col("id").alias("example_id"),
        F.col("n").cast("string").alias("text"),
        rollouts.reward_value(A.answers_match(F.col("n").cast("string"), F.array(F.col("n").cast("string")))).alias("reward"),
    )
    columns = ["example_id", "is_gt", "timestep", "text", "reward", "lst_reward"]
    return rollouts.with_ground_truth(log, truth).select(*columns)


@query(
    f"""with {_GRADED_SQL} , f as (select example_id, rollout_id, step_id, timestep, label, final_text from graded,
      (select unnest([0,1,2,3,4,5]) as step_id, unnest([999,749,499,249,0,0]) as timestep))
    select example_id, count(*) as facts, sum(label) as positives, sum(timestep)::double as timesteps, sum(step_id * (rollout_id + 1))::bigint as steps,
       sum(length(final_text))::bigint as chars from f group by example_id"""
)
def rollout_fact(spark, sf_dir):
    """The fact table of graded rollouts, summed per problem."""
    facts = rollouts.rollout_facts(
        graded(spark, sf_dir).withColumnRenamed("question", "input"), inputs.STEPS
    )
    return facts.groupBy("example_id").agg(
        F.count(F.lit(1)).alias("facts"),
        F.sum("label").alias("positives"),
        F.sum("timestep").alias("timesteps"),
        F.sum(F.col("step_id") * (F.col("rollout_id") + 1)).alias("steps"),
        F.sum(F.length("final_text")).alias("chars"),
    )
