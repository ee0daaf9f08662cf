r"""The trie of conversations' common beginnings, by prefix doubling.

Each turn gets a number for its role and text; blocks of 2, 4, 8, ... turns, each starting at a
multiple of its length, get the number of the pair of halves, so after as many join rounds as the
longest conversation's length has binary digits all blocks are named. A beginning of d turns is the
beginning without d's lowest binary digit followed by one such block, so going through the digits
from the highest to the lowest names every beginning in as many rounds again. Beginnings of equal
length and name are one node of the trie.

Sums over subtrees need no walk up the levels: a node's cost belongs to its smallest member, summed
from each depth of that member on to its end, and a node adds up what its members have at its depth.

Scale: numbers are given without gaps by sorting nothing and collecting nothing (`dense_names`); texts
become SHA-256 digests in the first step and are never shuffled again but to order equal turns. Hot
turns, nodes and conversations meet in map-side sums and in joins that Spark can split; sums along a
conversation are taken in blocks of BLOCK turns. The digest of a node's ends streams through one task.

Defined cases: rows without a conversation id belong to none; null roles and texts are empty; turns are
taken by number (null first), equal ones by role, then text, and repeated rows count each; a
conversation that is rebuilt without turns is a member of the root only; an empty table gives no node.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fastbreak.llm.common import materialize, scratch, words
from fastbreak.llm.turns import crc_sql, dense_names, digests, numbered

BLOCK = 4096

#: Conversations take the first turns of the one whose id is the next multiple of this towards 0.
GROUP, MOST_SHARED = 20, 3


def shared_turns(conv: Column) -> Column:
    return F.crc32(conv.cast("string").cast("binary")) % (MOST_SHARED + 1)


def turns_of(conversations: DataFrame) -> DataFrame:
    """conv_id, pos, said (digest of role and text) and n_words of every turn."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    rows = conversations.where("conv_id IS NOT NULL").select("conv_id", "turn", role.alias("role"), text.alias("text"))
    said = F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")).cast("binary"), 256)
    narrow = [said.alias("said"), F.size(words(F.col("text"))).cast("bigint").alias("n_words")]
    return numbered(rows.select("conv_id", "turn", "role", "text", *narrow), "conv_id", F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")).select("conv_id", "pos", "said", "n_words")


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Turns of every conversation after it took the first turns of its group's; conv_id and length of all, turnless ones too."""
    shared = shared_turns(F.col("conv_id"))
    sizes = materialize(turns.groupBy("conv_id").agg(F.count("*").alias("own")).withColumn("shared", shared), "sizes")
    first = turns.where(F.col("pos") < MOST_SHARED).withColumnRenamed("conv_id", "base")
    takers = sizes.where("shared > 0").select("conv_id", "shared", (F.col("conv_id") - F.col("conv_id") % GROUP).alias("base"))
    taken = materialize(takers.join(first, "base").where("pos < shared").select("conv_id", "pos", "said", "n_words"), "taken")
    got = taken.groupBy("conv_id").agg(F.count("*").alias("got"))
    sizes = sizes.join(got, "conv_id", "left").fillna(0, ["got"])
    lengths = materialize(sizes.select("conv_id", "shared", "got", (F.col("got") + F.greatest(F.col("own") - F.col("shared"), F.lit(0))).alias("length")), "lengths")
    rest = turns.where(F.col("pos") >= shared)
    short = lengths.where("got < shared").select("conv_id", (F.col("shared") - F.col("got")).alias("lost"))
    rest = rest.join(short, "conv_id", "left").select("conv_id", (F.col("pos") - F.coalesce("lost", F.lit(0))).alias("pos"), "said", "n_words")
    return materialize(taken.unionByName(rest), "rebuilt"), lengths.select("conv_id", "length")


def beginnings(turns: DataFrame, longest: int) -> DataFrame:
    """conv_id, depth (from 1) and name: equal names of equal depth are equal beginnings. `turns` has conv_id, pos, said."""
    named = dense_names(turns.select("conv_id", F.col("pos").alias("block"), "said"), ["said"], "name").select("conv_id", "block", "name")
    blocks = [named]
    while 2 << (len(blocks) - 1) <= longest:
        half = F.when(F.col("block") % 2 == 0, F.col("name")).alias("left"), F.when(F.col("block") % 2 == 1, F.col("name")).alias("right")
        pairs = blocks[-1].select("conv_id", F.expr("block div 2").alias("block"), *half).groupBy("conv_id", "block").agg(F.max("left").alias("left"), F.max("right").alias("right"))
        blocks.append(dense_names(pairs.where("right IS NOT NULL"), ["left", "right"], "name").select("conv_id", "block", "name"))
    done = None
    for digit in reversed(range(len(blocks))):
        size = 1 << digit
        odd = blocks[digit].where("block % 2 = 0").select("conv_id", (F.col("block") * size).alias("before"), ((F.col("block") + 1) * size).alias("depth"), F.col("name").alias("tail"))
        if done is None:
            head = odd.withColumn("head", F.lit(0).cast("bigint"))
        else:
            known = done.select("conv_id", F.col("depth").alias("before"), F.col("name").alias("head"))
            head = odd.where("before > 0").join(known, ["conv_id", "before"]).unionByName(odd.where("before = 0").withColumn("head", F.lit(0).cast("bigint")), allowMissingColumns=True)
        fresh = dense_names(head.select("conv_id", "depth", "head", "tail"), ["depth", "head", "tail"], "name").select("conv_id", "depth", "name")
        done = fresh if done is None else done.unionByName(fresh)
    return done


def to_end(rows: DataFrame, value: str) -> DataFrame:
    """`rows` (conv_id, depth, ...) with `value` replaced by its sum over the same conversation from this depth on."""
    rows = rows.withColumn("_block", F.expr(f"depth div {BLOCK}"))
    after = rows.groupBy("conv_id", "_block").agg(F.sum(value).alias("_sum"))
    later = after.select("conv_id", "_block", (F.sum("_sum").over(Window.partitionBy("conv_id").orderBy(F.desc("_block"))) - F.col("_sum")).alias("_later")).where("_later > 0")
    here = F.sum(value).over(Window.partitionBy("conv_id", "_block").orderBy(F.desc("depth")))
    return rows.withColumn(value, here).join(later, ["conv_id", "_block"], "left").withColumn(value, F.col(value) + F.coalesce("_later", F.lit(0))).drop("_block", "_later")


def trie(turns: DataFrame, lengths: DataFrame) -> DataFrame:
    """One row per node; `turns` has conv_id, pos (from 0 without gaps), said and n_words, `lengths` all conversations."""
    longest = lengths.agg(F.max("length")).first()[0] or 0
    root = lengths.select("conv_id", F.lit(0).cast("bigint").alias("depth"), F.lit(0).cast("bigint").alias("name"), F.lit(0).cast("bigint").alias("n_words"))
    each = root
    if longest:
        each = root.unionByName(beginnings(turns, longest).join(turns.select("conv_id", (F.col("pos") + 1).alias("depth"), "n_words"), ["conv_id", "depth"]))
    each = materialize(each, "beginnings")
    # a node is known by its smallest member and its depth
    nodes = each.groupBy("depth", "name").agg(F.min("conv_id").alias("node"), F.count("*").alias("n_convs"), F.max("n_words").alias("n_words"))
    nodes = materialize(nodes, "nodes")
    members = materialize(each.select("conv_id", "depth", "name").join(nodes.select("depth", "name", "node"), ["depth", "name"]).select("conv_id", "depth", "node"), "members")
    at = members.select(F.col("conv_id").alias("node"), (F.col("depth") + 1).alias("depth"), F.col("node").alias("parent"))
    nodes = materialize(nodes.drop("name").join(at, ["node", "depth"], "left"), "parents")
    children = nodes.where("parent IS NOT NULL").groupBy(F.col("parent").alias("node"), (F.col("depth") - 1).alias("depth")).agg(F.count("*").alias("n_children"))
    nodes = materialize(nodes.join(children, ["node", "depth"], "left").fillna(0, ["n_children"]), "children")
    cost = nodes.select(F.col("node").alias("conv_id"), "depth", ((F.col("n_convs") - 1) * F.col("n_words")).alias("saved"), (F.col("n_children") == 0).cast("bigint").alias("leaves"))
    # a leaf is its smallest member's last node: both sums run from a depth on to the end
    along = members.join(cost, ["conv_id", "depth"], "left").fillna(0, ["saved", "leaves"])
    along = to_end(to_end(along, "saved"), "leaves")
    sums = along.groupBy("node", "depth").agg(F.sum("saved").alias("saved_tokens"), F.sum("leaves").alias("n_leaves"))
    ends = members.join(lengths.withColumnRenamed("length", "depth"), ["conv_id", "depth"]).withColumn("id", F.col("conv_id").cast("string"))
    ends = digests(ends, ["node", "depth"], ["conv_id"], "id", ",", "ends_sha256")
    whole = nodes.join(sums, ["node", "depth"]).join(ends, ["node", "depth"], "left")
    return whole.select(F.col("node").alias("conv_id"), "depth", F.col("parent").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.sha2(F.lit(b""), 256)).alias("ends_sha256"))


def op13_prefix_trie(conversations: DataFrame) -> DataFrame:
    """The query: conversations rebuilt with the first turns of their group's, and every node of their trie."""
    with scratch(conversations.sparkSession) as keep:
        return keep(materialize(trie(*rebuilt(turns_of(conversations))), "trie"))


#: DuckDB: a beginning as the digests of its turns in a row; subtrees by comparing each node with the beginnings of its smallest member.
SQL = rf"""
WITH src AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) - 1 AS pos,
         sha256(length(coalesce(role, ''))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, '')) AS said,
         len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS n_words
  FROM conversations WHERE conv_id IS NOT NULL),
conv AS (SELECT conv_id, {crc_sql("conv_id::VARCHAR")} % 4 AS h FROM (SELECT DISTINCT conv_id FROM src)),
mixed AS (
  SELECT c.conv_id, 0 AS own, pos, said, n_words FROM conv c JOIN src ON src.conv_id = c.conv_id - c.conv_id % 20 AND pos < h
  UNION ALL SELECT c.conv_id, 1, pos, said, n_words FROM conv c JOIN src USING (conv_id) WHERE pos >= h),
turns AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY own, pos) AS depth FROM mixed),
long AS (SELECT conv.conv_id, count(depth) AS length FROM conv LEFT JOIN turns USING (conv_id) GROUP BY ALL),
begun AS (
  SELECT conv_id, depth, string_agg(said, '') OVER (PARTITION BY conv_id ORDER BY depth) AS name, n_words FROM turns
  UNION ALL SELECT conv_id, 0, '', 0 FROM conv),
node AS (
  SELECT depth, name, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(n_words) AS n_words, coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (length = depth), '') AS ends
  FROM begun JOIN long USING (conv_id) GROUP BY depth, name),
member AS (SELECT begun.conv_id AS member, begun.depth, node.conv_id FROM begun JOIN node USING (depth, name)),
tree AS (SELECT node.*, up.conv_id AS parent FROM node LEFT JOIN member up ON up.member = node.conv_id AND up.depth = node.depth - 1),
child AS (SELECT parent AS conv_id, depth - 1 AS depth, count(*) AS n FROM tree WHERE parent IS NOT NULL GROUP BY ALL),
full_tree AS (SELECT tree.*, coalesce(n, 0) AS n_children FROM tree LEFT JOIN child USING (conv_id, depth)),
sums AS (
  SELECT up.conv_id, up.depth, sum((x.n_convs - 1) * x.n_words) AS saved, count(*) FILTER (x.n_children = 0) AS leaves
  FROM full_tree x JOIN member up ON up.member = x.conv_id AND up.depth <= x.depth GROUP BY ALL)
SELECT conv_id, depth::BIGINT AS depth, parent AS parent_conv_id, n_convs::BIGINT AS n_convs, n_children::BIGINT AS n_children, leaves::BIGINT AS n_leaves, saved::BIGINT AS saved_tokens, sha256(ends) AS ends_sha256
FROM full_tree JOIN sums USING (conv_id, depth)
"""
