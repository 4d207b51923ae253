"""Queries that pass simple callables through the user hooks."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

from ..operators import corpus, hooks, rollouts
from . import inputs, oracle as O
from .registry import query


@query("select doc_id, n_chars * 2 + 1 as value from documents")
def row_map(spark, sf_dir):
    """A record function over all documents."""
    df = inputs.table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    return hooks.map_rows(
        df,
        lambda record, factor: {"doc_id": record["doc_id"], "value": record["n_chars"] * factor + 1},
        "doc_id long, value long",
        factor=2,
    )


@query("select doc_id, length(text) as chars, true as bounded from documents")
def batched_map(spark, sf_dir):
    """A batch function over all documents, with the batch bound it saw."""

    def measure(batch, limit):
        return batch.assign(chars=batch["text"].str.len(), bounded=len(batch) <= limit)[["doc_id", "chars", "bounded"]]

    df = inputs.table(spark, sf_dir, "documents").select("doc_id", "text")
    return hooks.map_batches(df, measure, "doc_id long, chars long, bounded boolean", batch_rows=64, limit=64)


@query(f"with {O.TOKENS} select doc_id, {O.joined('ids')} as ids from tokens")
def tokenize_hook(spark, sf_dir):
    """The hashed whitespace tokenizer as a user callable."""

    def factory():
        from hashlib import md5

        def encode(texts):
            return [[int(md5(w.encode()).hexdigest()[:7], 16) % 30000 + 10 for w in t.split()] for t in texts]

        return encode

    filled = corpus.drop_blank(inputs.table(spark, sf_dir, "documents"), "text")
    return filled.select("doc_id", hooks.tokenize("text", factory).alias("ids")).select(
        "doc_id", F.array_join(F.transform("ids", lambda i: i.cast("string")), ",").alias("ids")
    )


@query("select doc_id, length(text)::double as first, length(text)::double / 2 as second from documents")
def encode_hook(spark, sf_dir):
    """A stand-in encoder from text to a two-element latent."""

    def factory():
        def encode(batch):
            sizes = batch["text"].str.len().astype("float64")
            return batch[["doc_id"]].assign(latent=[[s, s / 2] for s in sizes])

        return encode

    df = inputs.table(spark, sf_dir, "documents").select("doc_id", "text")
    encoded = hooks.run_model(df, factory, "doc_id long, latent array<double>")
    return encoded.select("doc_id", F.col("latent")[0].alias("first"), F.col("latent")[1].alias("second"))


@query("select vec_id, 'v' || label || ':' || len(embedding) as text from embeddings")
def decode_hook(spark, sf_dir):
    """Latents to texts with a stand-in decoder."""

    def factory():
        def decode(batch):
            texts = [f"v{label}:{len(z)}" for label, z in zip(batch["label"], batch["embedding"])]
            return batch[["vec_id"]].assign(text=texts)

        return decode

    vectors = inputs.table(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding")
    return hooks.run_model(vectors, factory, "vec_id long, text string")


@query(
    f"""with scored as (select vec_id, label, round(list_sum(embedding::double[]), 6) as reward from embeddings)
    select label::bigint as label, {O.micro_scalar('max(reward)')} as reward from scored group by label"""
)
def reward_hook(spark, sf_dir):
    """Best reward per label from a stand-in scorer."""

    def factory():
        def score(ids, latent, timestep):
            return [round(float(z.astype("float64").sum()) + t, 6) for z, t in zip(latent, timestep)]

        return score

    vectors = inputs.table(spark, sf_dir, "embeddings")
    scored = vectors.select("vec_id", "label", hooks.reward(F.array(F.lit(1)), "embedding", factory).alias("reward"))
    best = rollouts.best_of_n(scored, "label", "vec_id")
    return best.select("label", F.round(F.col("reward") * 1e6).cast("long").alias("reward"))


@query(
    """select vec_id, rollout_id, step_id, label * 100 + rollout_id * 10 + step_id as value
    from embeddings, (select unnest(range(4)) as rollout_id), (select unnest(range(3)) as step_id)"""
)
def rollout_udtf(spark, sf_dir):
    """A generator that turns each vector row into rollouts and steps."""

    @udtf(returnType="rollout_id int, step_id int, value int", useArrow=True)
    class Generate:
        def eval(self, label: int):
            for rollout in range(4):
                for step in range(3):
                    yield rollout, step, label * 100 + rollout * 10 + step

    vectors = inputs.table(spark, sf_dir, "embeddings").select("vec_id", "label")
    return hooks.generate_rollouts(vectors, Generate, "label").drop("label")


class _Standing:
    """Per rollout of an example its states and reward, beside the reward of the rollouts before it."""

    def __init__(self):
        self.now, self.before = None, 0

    def add(self, row):
        done, now = (), self.now
        if now is None or row.rollout_id != now[1]:
            done = self.finish()
            self.now = now = [row.example_id, row.rollout_id, 0, 0]
        now[2] += 1
        now[3] += int(row.reward)
        return done

    def finish(self):
        if self.now is None:
            return ()
        made = (*self.now, self.before)
        self.before += self.now[3]
        return (made,)


@query(
    f"""with {O.TRAJECTORIES},
    own as (select example_id, rollout_id, count(*) as states, sum(reward)::bigint as reward from trajectories group by 1, 2)
    select *, coalesce(sum(reward) over (partition by example_id order by rollout_id rows between unbounded preceding and 1 preceding), 0)::bigint as before
    from own"""
)
def rollout_udtf_partitioned(spark, sf_dir):
    """A generator that sees all states of an example in order, and emits a row per rollout. They are sent packed."""
    states = inputs.trajectories(spark, sf_dir).select("example_id", "rollout_id", "step_id", "reward")
    made = hooks.generator_per_example(
        _Standing, "example_id long, rollout_id int, states long, reward long, before long", needs=("reward",)
    )
    return made(hooks.pack_rows(states, needs=("reward",)).asTable())
