"""Shards by a hierarchical weighted hash tree of regions, racks and shards.

A row descends the tree: at each level every child draws a number from the row's key and the child's own
name, exponentially distributed with the child's weight as its rate, and the smallest draw wins. A child is
chosen as often as its share of the weight, and a draw depends on nothing but the key, the name and
the child's own weight. So when the weight of a shard changes, and with it that of its rack and region, a
row can only move into or out of a subtree whose weight changed: between two children that kept their
weights the order of draws is what it was. At each level this holds by itself; rows whose region stays
compare the same racks, and so on.

`even(shards)` is a tree of equal regions and racks. A shard that is added later must take rows only into
itself, whatever level it is at; in a rack of its region it would also bring rows to its neighbours, because
the region grows. `with_shard` therefore hangs it from the root, as a region of its own with the weight
of one shard: then no other weight changes, and whatever it does not draw stays where it is.

Everything is expressions: one digest per child a row looks at (regions, the racks of one region, the shards of one
rack), so the work per row grows with the sizes of the levels, not with the number of shards. The tree travels in the
plan as literals, a few per shard.

Rows: a null key is a value like any other, so rows with a null key share a shard, as do all rows of one key
(the key decides); rows that repeat are placed once per row; null and empty texts have no bytes; a text of
any length is read in place and never shuffled; ties of two draws go to the child listed first; an empty
table gives an empty result. Only the columns named are read, whatever others the table has.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import uniform
from ..operators.numbering import range_positions
from .common import save

#: Bytes that a document takes besides its text.
OVERHEAD = 8
SEED = "shards"


@dataclass(frozen=True)
class Shard:
    shard: int
    region: str
    rack: str
    weight: float = 1.0


@dataclass(frozen=True)
class Tree:
    """Shards with their places. Racks belong to one region each, by (region, rack)."""

    shards: tuple[Shard, ...]

    def __post_init__(self):
        numbers = [s.shard for s in self.shards]
        if not numbers or len(set(numbers)) < len(numbers):
            raise ValueError("a tree needs shards, each with a number of its own")
        if min(s.weight for s in self.shards) < 0 or not any(s.weight for s in self.shards):
            raise ValueError("weights must not be negative, nor all zero")

    @classmethod
    def even(cls, shards: int, racks: int = 4, regions: int = 8) -> Tree:
        """`shards` shards of weight 1, `racks` to a rack and `regions` to a region."""
        return cls(tuple(Shard(i, f"region-{i // regions}", f"rack-{i // racks}") for i in range(shards)))

    def with_shard(self, weight: float = 1.0) -> Tree:
        """One more shard, which takes rows only into itself."""
        number = max(s.shard for s in self.shards) + 1
        return Tree((*self.shards, Shard(number, f"added-{number}", f"added-{number}", weight)))

    def with_weight(self, shard: int, weight: float) -> Tree:
        changed = [Shard(s.shard, s.region, s.rack, weight) if s.shard == shard else s for s in self.shards]
        return Tree(tuple(changed))


def _score(key: Column, name: str, weight: float) -> Column:
    """Exponential with rate `weight`, from a digest: the smallest of several wins by its share of the weights."""
    return -F.ln(1.0 - uniform(SEED, F.lit(name), key)) / F.lit(float(weight))


def _pick(key: Column, children: list[tuple[str, float, Column]]) -> Column:
    """The value of the child with the smallest draw, the first one on ties; null if all weights are zero."""
    drawn = [(name, weight, value) for name, weight, value in children if weight > 0]
    if len(drawn) == 1:
        return drawn[0][2]
    scores = F.array(*[_score(key, name, weight) for name, weight, _ in drawn])
    return F.get(F.array(*[value for *_, value in drawn]), F.array_position(scores, F.array_min(scores)) - 1)


def _groups(shards: Sequence[Shard], level: str) -> dict[str, list[Shard]]:
    found: dict[str, list[Shard]] = {}
    for s in shards:
        if s.weight > 0:
            found.setdefault(getattr(s, level), []).append(s)
    return found


def _weight(shards: Sequence[Shard]) -> float:
    return sum(s.weight for s in shards)


def _chosen(number: Column, values: list[Column]) -> Column:
    """values[number], evaluating that one only."""
    found = values[-1]
    for i, value in reversed(list(enumerate(values[:-1]))):
        found = F.when(number == i, value).otherwise(found)
    return found


def assign(df: DataFrame, key: str, tree: Tree, output: str = "shard") -> DataFrame:
    """Append the shard of each row's key."""
    k = F.col(f"`{key}`")
    regions = _groups(tree.shards, "region")
    racks = {r: _groups(shards, "rack") for r, shards in regions.items()}
    sizes = [(r, _weight(shards), F.lit(i)) for i, (r, shards) in enumerate(regions.items())]
    region = F.col("__region")
    # One column per level, so that a later level looks at the chosen child alone.
    in_region = [
        _pick(k, [(f"{r}/{c}", _weight(shards), F.lit(i)) for i, (c, shards) in enumerate(children.items())])
        for r, children in racks.items()
    ]
    in_rack = [
        _chosen(
            F.col("__rack"),
            [_pick(k, [(f"{r}/{c}/{s.shard}", s.weight, F.lit(s.shard)) for s in shards]) for c, shards in children.items()],
        )
        for r, children in racks.items()
    ]
    df = df.withColumn("__region", _pick(k, sizes))
    df = df.withColumn("__rack", _chosen(region, in_region))
    return df.withColumn(output, _chosen(region, in_rack)).drop("__region", "__rack")


def shard_documents(
    docs: DataFrame, tree: Tree, grown: Tree | None = None, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """Per document: doc_id, size, text_crc32, law, shard, slot and grown_shard.

    `size` is the text's bytes plus OVERHEAD, `slot` the place in the shard by ascending doc_id, and
    `grown_shard` the shard under the tree `grown` (one more shard than `tree`, unless another is given).
    Texts are measured where they lie; only numbers are shuffled, by ranges of (shard, doc_id), so a shard
    is numbered by as many tasks as its size asks for."""
    content = F.coalesce(F.col(f"`{text}`"), F.lit("")).cast("binary")
    narrow = docs.select(
        F.col(f"`{doc_id}`").alias("doc_id"),
        (F.octet_length(content) + F.lit(OVERHEAD)).cast("long").alias("size"),
        F.crc32(content).alias("text_crc32"),
    )
    narrow = assign(narrow, "doc_id", tree, "shard")
    narrow = save(assign(narrow, "doc_id", grown or tree.with_shard(), "grown_shard"), "sharded")
    numbered = range_positions(narrow, ["doc_id", "size", "text_crc32"], "slot", within=["shard"])
    return numbered.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")
