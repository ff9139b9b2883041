"""A model from trees: parsed, tagged, reranked, saved and loaded again."""

import pytest
from pyspark.sql import functions as F

from sylva.model import Catalog, Model, ModelInfo, UnknownModel, lowered_words
from sylva.operators import parser, treefeatures
from sylva.sources import ptb

TREES = ["(S1 (S (NP (D the) (N cat)) (VP (V sat))))", "(S1 (S (NP (N dogs)) (VP (V saw) (NP (D the) (N cat)))))", "(S1 (S (NP (N dogs) (N sat)) (VP (V saw))))"]


def test_model(spark, tmp_path):
    trees = spark.createDataFrame(list(enumerate(TREES)), "sent_id long, tree string")
    nodes = ptb.read_nodes(trees)
    tokens = nodes.where("word IS NOT NULL").selectExpr("sent_id", "start AS pos", "word AS form", "label AS tag")
    with pytest.raises(ValueError, match="no parser"):
        Model().parse(tokens)
    model = Model().load_parser(parser.train_grammar(nodes), tokens.unionAll(tokens).unionAll(tokens).select("pos", "form", "tag"))
    with pytest.raises(RuntimeError, match="already"):
        model.load_parser(model.grammar, tokens)
    with pytest.raises(ValueError, match="no ranker"):
        model.parse(tokens, rerank=True)
    weights = treefeatures.tree_features(trees.withColumn("k", F.lit(0)), ["Rule"]).select("cls", "feat").distinct().withColumn("w", F.lit(1.0))
    model.load_ranker(weights, ["Rule"])
    parses = {(r.sent_id, r.k): r for r in model.parse(tokens).collect()}
    assert {s for s, _ in parses} == {0, 1, 2} and parses[0, 0].tree == TREES[0] and parses[0, 0].reranker_score > 0
    tags = {r.sent_id: r.tags for r in model.tag(tokens).collect()}
    assert tags[0] == ["D", "N", "V"] and tags[1] == ["N", "V", "D", "N"]
    strange = spark.createDataFrame([(7, 0, "the"), (7, 1, "the")], "sent_id long, pos int, form string")
    with pytest.raises(Exception, match="no parse for 7"):
        model.tag(strange).collect()
    assert model.tag(strange, allow_failures=True).first().tags == ["D", "D"]
    model.with_options(nbest=3).save(str(tmp_path / "m"))
    catalog = Catalog([ModelInfo("small", str(tmp_path / "m"), "three trees")])
    again = catalog.load(spark, "small")
    assert again.parts() == (True, True, False) and again.options.nbest == 3 and again.classes == ["Rule"]
    assert {(r.sent_id, r.k): r.tree for r in again.parse(tokens).collect()} == {x: r.tree for x, r in parses.items() if x[1] < 3}
    assert catalog.table(spark).first().name == "small"
    with pytest.raises(UnknownModel, match="small"):
        catalog.info("large")
    assert spark.createDataFrame([("(S1 (NP-SBJ (NNP Ann) (NN B-C)))",)], "t string").select(lowered_words(F.col("t"))).first()[0] == "(S1 (NP-SBJ (NNP ann) (NN b-c)))"
