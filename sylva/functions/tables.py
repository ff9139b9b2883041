"""Table functions for SQL: register(spark), then

    SELECT t.sent_id, n.* FROM trees t, LATERAL tree_nodes(t.tree) n
    SELECT * FROM best_parses(TABLE(lists), 3)

| function | rows |
|-|-|
| tree_nodes(tree) | node, parent, depth, start, finish, label, word of each constituent, in pre-order |
| tree_dependencies(tree) | i, gov, dep, gov_word, dep_word: word places, by the first-stage heads |
| sentence_tokens(sentence) | pos, form by the full tokenizer |
| best_parses(TABLE(lists), n) | the columns of lists (sent_id, k, logprob and any others) and rank, the first n of each sentence |

A text that isn't one tree, or is null, has no rows. best_parses declares itself how its table is dealt and sorted (by
sent_id; logprob falling, then k), so Spark does both and a task holds one row.
"""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.functions import AnalyzeArgument, AnalyzeResult, OrderingColumn, PartitioningColumn, udtf
from pyspark.sql.types import IntegerType, StructType


class TreeNodes:
    def eval(self, tree: str):
        from sylva.functions.rowtree import RowTree

        t = RowTree.read(tree)
        depth: list[int] = []
        for k in range(len(t) if t is not None else 0):
            up = t.parent[k]
            depth.append(depth[up] + 1 if up >= 0 else 0)
            yield k, up if up >= 0 else None, depth[k], t.start[k], t.finish[k], t.label[k], t.word[k]


class TreeDependencies:
    def eval(self, tree: str):
        from sylva.functions import heads
        from sylva.functions.rowtree import RowTree

        t = RowTree.read(tree)
        if t is not None:
            t = heads.seen_by(t, "first")
            for i, (g, d) in enumerate(heads.dependencies(t, heads.lexical_heads(t, heads.head_children(t, heads.first_stage)))):
                yield i, t.start[g], t.start[d], t.word[g], t.word[d]


class SentenceTokens:
    def eval(self, sentence: str):
        from sylva.functions.tokenizer import tokenize

        yield from enumerate(tokenize(sentence)) if sentence else ()


class BestParses:
    """Rows come sentence by sentence, best first, so a count is all that is kept."""

    @staticmethod
    def analyze(lists: AnalyzeArgument, n: AnalyzeArgument) -> AnalyzeResult:
        if not lists.isTable or not {"sent_id", "k", "logprob"} <= {f.name for f in lists.dataType.fields}:
            raise ValueError("best_parses needs a table with sent_id, k and logprob")
        if n.value is None or int(n.value) < 1:
            raise ValueError("best_parses needs how many parses to keep")
        schema = StructType([*lists.dataType.fields]).add("rank", IntegerType())
        return AnalyzeResult(schema, partitionBy=[PartitioningColumn("sent_id")], orderBy=[OrderingColumn("logprob", ascending=False), OrderingColumn("k")])

    def __init__(self) -> None:
        self.rank = 0

    def eval(self, row, n: int):
        self.rank += 1
        if self.rank <= n:
            yield (*row, self.rank)


def register(spark: SparkSession) -> None:
    """Make the functions known to a session's SQL."""
    spark.udtf.register("tree_nodes", udtf(TreeNodes, returnType="node int, parent int, depth int, start int, finish int, label string, word string", useArrow=True))
    spark.udtf.register("tree_dependencies", udtf(TreeDependencies, returnType="i int, gov int, dep int, gov_word string, dep_word string", useArrow=True))
    spark.udtf.register("sentence_tokens", udtf(SentenceTokens, returnType="pos int, form string", useArrow=True))
    spark.udtf.register("best_parses", udtf(BestParses))
