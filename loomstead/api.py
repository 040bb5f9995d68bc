"""What a program asks of a loaded graph, one function for each kind of answer; every answer is a DataFrame.

Tables are those of the loads: entities, aliases, mentioned_in, spoke_in, sent, claims, evidenced_by, about, contradicts,
supersedes, disagreements, over (of one or several generations), surfaces and denotes.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .operators import arbitrate as A
from .operators import asking as Q
from .operators import claims_graph as B
from .operators import graph as G


class Api:
    def __init__(self, tables: dict[str, DataFrame], gen: str, library: Q.Library | None = None):
        self.t, self.gen, self.library = tables, gen, library

    def _now(self, name: str) -> DataFrame:
        return B.in_generation(self.t[name], self.gen)

    def stats(self) -> DataFrame:
        """(what, n) for every table."""
        counts = [df.agg(F.count("*").alias("n")).select(F.lit(name).alias("what"), "n") for name, df in sorted(self.t.items())]
        return reduce(DataFrame.union, counts)

    def ask(self, questions: DataFrame, limit: int = Q.FOUND) -> dict[str, DataFrame]:
        return Q.retrieve(questions, self.library, limit)

    def entity(self, eid: DataFrame) -> DataFrame:
        """An entity's most frequent forms and what speaks for them."""
        rows = self.t["resolves_to"].join(self.t["aliases"], "key")
        return G.aliases_of(rows, eid)

    def who(self, text: DataFrame) -> DataFrame:
        """Whom texts (text) denote, and how many that are."""
        return G.denoted_by(text, self.t["denotes"].withColumnRenamed("text", "surface"))

    def ontology(self, limit: int = 50) -> DataFrame:
        return self.t["entities"].orderBy(F.desc("occurrences"), "eid").limit(limit)

    def disagreements(self, limit: int = 40, predicate: str | None = None, scope: str | None = None, undecided: bool = False) -> DataFrame:
        return A.disagreement_map(self._now("disagreements"), limit, predicate, scope, undecided)

    def disagreement(self, key: str) -> DataFrame:
        """The claims of one disagreement by side."""
        return self._now("over").where(F.col("key") == key).join(self._now("claims").drop("gen", "status"), "claim_id").orderBy("side", F.desc("trust"), "claim_id")

    def history(self, claim_id: str) -> DataFrame:
        """The longest chain of claims that a claim has outdated, from it on."""
        return G.history(self._now("supersedes").select("src", "dst")).where(F.col("root") == claim_id)

    def blast(self, claim_id: str, each: int = 200) -> DataFrame:
        """Who is exposed to a claim through its document, at the strongest role."""
        docs = self._now("evidenced_by").where(F.col("claim_id") == claim_id).select("claim_id", "doc_id")
        names = self.t["entities"].select("eid", F.col("canonical_name").alias("name"))
        return G.exposure(docs, [(role, self.t[edge].join(names, "eid").select("eid", "name", "doc_id")) for role, edge in (("sent", "sent"), ("spoke in", "spoke_in"), ("named in", "mentioned_in"))], each)

    def contradicted_by(self, claim_id: str, limit: int = 20) -> DataFrame:
        return B.contradicted_by(self._now("contradicts").where(F.col("src") == claim_id), self._now("claims"), limit)

    def claims_about(self, eid: DataFrame, limit: int = 50) -> DataFrame:
        return B.claims_about(self._now("about").join(eid.select("eid").distinct(), "eid", "left_semi"), self._now("claims"), limit)

    def claim_stats(self) -> DataFrame:
        return self._now("claims").groupBy("predicate", "status").agg(F.count("*").alias("claims"))

    def graded(self, questions: DataFrame, grades: DataFrame) -> DataFrame:
        return Q.grades_of(questions, grades)
