"""A model as a folder of tables: the parser's and the ranker's, saved, loaded and listed; options and guards of a loaded one.

There is no fetching of models over a network: the catalog lists folders that are there.
"""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sylva.operators import features, nbest, nbestparser, treefeatures
from sylva.operators.nbestparser import Options
from sylva.operators.parser import Grammar, lattice


class UnknownModel(ValueError):
    """A model's name that the catalog doesn't have."""


@dataclass
class Model:
    """Tables by name (a parser's: grammar, lexicon; a ranker's: dictionary, weights), options, and the ranker's feature classes."""

    tables: dict[str, DataFrame] = field(default_factory=dict)
    options: Options = Options()
    classes: list[str] = field(default_factory=lambda: list(treefeatures.SETS["base"]))
    grammar: Grammar | None = None

    # --- loading and guards

    def load_parser(self, grammar: Grammar, lexicon: DataFrame) -> Model:
        """The parser's tables; a model takes them once. lexicon: tagged tokens (pos, form, tag)."""
        if self.grammar is not None:
            raise RuntimeError("the parser's model is already loaded")
        self.grammar, self.tables = grammar, self.tables | {"lexicon": lexicon}
        return self

    def load_ranker(self, weights: DataFrame, classes: list[str] | str = "base") -> Model:
        """The ranker's weights (cls, feat, w) and classes; a model takes them once."""
        if "weights" in self.tables:
            raise RuntimeError("the ranker's model is already loaded")
        self.classes = treefeatures.SETS[classes] if isinstance(classes, str) else classes
        [treefeatures.build(c) for c in self.classes]
        self.tables = self.tables | {"weights": weights}
        return self

    def _need(self, what: str) -> None:
        if what == "parser" and self.grammar is None:
            raise ValueError("no parser model is loaded")
        if what == "ranker" and "weights" not in self.tables:
            raise ValueError("no ranker model is loaded")

    def with_options(self, **changes) -> Model:
        return Model(dict(self.tables), Options(**{**asdict(self.options), **changes}), list(self.classes), self.grammar)

    # --- use

    def lattice(self, tokens: DataFrame) -> DataFrame:
        """sent_id, forms, tags of tokens (sent_id, pos, form)."""
        self._need("parser")
        o = self.options
        return lattice(tokens, self.tables["lexicon"], o.smooth_pos, o.language, o.case_insensitive)

    def parse(self, tokens: DataFrame, rerank: bool | None = None) -> DataFrame:
        """sent_id, k, logprob, tree and, with a ranker, reranker_score and both ranks. rerank None: if there's a ranker."""
        self._need("parser")
        if rerank:
            self._need("ranker")
        parses = nbestparser.parse_nbest(self.lattice(tokens), self.grammar, self.options)
        if rerank is None:
            rerank = "weights" in self.tables
        return self.rerank(parses) if rerank else parses

    def rerank(self, parses: DataFrame, lowercase: bool = True) -> DataFrame:
        """Lists (sent_id, k, logprob, tree) with reranker_score and ranks by the loaded weights; lowercase: features of lowered words."""
        self._need("ranker")
        seen = parses.withColumn("tree", lowered_words(F.col("tree"))) if lowercase else parses
        values = treefeatures.tree_features(seen, self.classes)
        return nbest.rerank(parses, features.sparse_score(values, self.tables["weights"]))

    def tag(self, tokens: DataFrame, allow_failures: bool = False) -> DataFrame:
        """sent_id, forms, tags of the best parse; a sentence without one gets its words' likeliest tags, or is an error."""
        self._need("parser")
        rows = self.lattice(tokens)
        best = nbestparser.simple_parse(rows, self.grammar, self.options)
        if not allow_failures:
            found = nbestparser.parse_nbest(rows, self.grammar, Options(**{**asdict(self.options), "nbest": 1})).select("sent_id", F.lit(True).alias("_ok"))
            best = best.join(found, "sent_id", "left").withColumn("tree", F.when(F.col("_ok").isNull(), F.raise_error(F.concat(F.lit("no parse for "), F.col("sent_id").cast("string"))).cast("string")).otherwise(F.col("tree"))).drop("_ok")
        leaf = r"\(([^\s()]+) +([^\s()]+)\)"
        return best.select("sent_id", F.regexp_extract_all("tree", F.lit(leaf), F.lit(2)).alias("forms"), F.regexp_extract_all("tree", F.lit(leaf), F.lit(1)).alias("tags"))

    # --- folders

    def save(self, path: str) -> None:
        """Write tables as Parquet under path/tables, and the grammar's arrays and the options as one row of JSON."""
        self._need("parser")
        for name, df in self.tables.items():
            df.write.mode("overwrite").parquet(f"{path}/tables/{name}")
        spark = self.tables["lexicon"].sparkSession
        g = self.grammar
        steps = np.argwhere(np.isfinite(g.steps))
        rows = [(int(p), int(a), int(b), float(g.steps[p, a, b])) for p, a, b in steps]
        spark.createDataFrame(rows, "p int, a int, b int, score double").write.mode("overwrite").parquet(f"{path}/grammar")
        about = {"labels": g.labels, "n_phrases": g.n_phrases, "root": g.root, "options": asdict(self.options), "classes": self.classes, "tables": sorted(self.tables)}
        spark.createDataFrame([(json.dumps(about),)], "about string").coalesce(1).write.mode("overwrite").parquet(f"{path}/about")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Model:
        """The model in a folder; a part that isn't there (a ranker) stays unloaded."""
        about = json.loads(spark.read.parquet(f"{path}/about").first().about)
        n = len(about["labels"])
        steps = np.full((about["n_phrases"], n + 1, n + 1), -np.inf)
        for r in spark.read.parquet(f"{path}/grammar").collect():  # bounded by the label set
            steps[r.p, r.a, r.b] = r.score
        tables = {name: spark.read.parquet(f"{path}/tables/{name}") for name in about["tables"]}
        return cls(tables, Options(**about["options"]), about["classes"], Grammar(about["labels"], about["n_phrases"], steps, about["root"]))

    def parts(self) -> tuple[bool, bool, bool]:
        """Whether there's a parser, a ranker's feature classes with weights, and a dictionary."""
        return self.grammar is not None, "weights" in self.tables, "dictionary" in self.tables


def lowered_words(tree):
    """A bracketed text with A to Z lowered in its words; labels stay."""
    marks = F.regexp_extract_all(tree, F.lit(r"[()]|[^\s()]+|\s+"), F.lit(0))
    is_word = lambda i: ~F.get(marks, i - 1).isin("(", ")") & (i > 0)
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.array_join(F.transform(marks, lambda x, i: F.when(is_word(i), F.translate(x, upper, lower)).otherwise(x)), "")


@dataclass(frozen=True)
class ModelInfo:
    name: str
    path: str
    description: str = ""
    language: str = "En"


class Catalog:
    """Models by name."""

    def __init__(self, models: list[ModelInfo] = ()) -> None:
        self.models = {m.name: m for m in models}

    def add(self, info: ModelInfo) -> None:
        self.models[info.name] = info

    def info(self, name: str) -> ModelInfo:
        if name not in self.models:
            raise UnknownModel(f"no model {name}; there are: {', '.join(sorted(self.models)) or 'none'}")
        return self.models[name]

    def table(self, spark: SparkSession) -> DataFrame:
        """name, path, description, language of all models."""
        return spark.createDataFrame([(m.name, m.path, m.description, m.language) for m in self.models.values()], "name string, path string, description string, language string")

    def load(self, spark: SparkSession, name: str) -> Model:
        return Model.load(spark, self.info(name).path)
