"""Many terms in many texts: which texts hold which terms, by an automaton or by rare pieces.

A list of terms of counted size becomes one automaton in each task, which reads a text once whatever
the number of terms. A larger list meets the texts by a piece of each term, the one that fewest texts
have, so that a common piece brings nothing together; what meets is then looked at in full. Both ways
give the same rows. Letters count alike in either case; a term that is null or empty is in no text.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Characters of terms up to which their automaton is in each task.
AUTOMATON_CHARS = 4_000_000
#: Characters of a piece of a term; a shorter term is its own piece.
PIECE = 4


def _by_automaton(units: DataFrame, terms: DataFrame) -> DataFrame:
    listed = [(r["term_id"], r["term"]) for r in terms.collect()]  # of counted size
    kind, known = units.schema["unit_id"].dataType.simpleString(), terms.schema["term_id"].dataType.simpleString()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import ahocorasick

        machine, ids = ahocorasick.Automaton(), {}
        for id_, term in listed:
            ids.setdefault(term, []).append(id_)
        for term, of in ids.items():
            machine.add_word(term, of)
        machine.make_automaton()
        for f in frames:
            rows = [(u, i) for u, text in zip(f["unit_id"], f["text"], strict=True) if text for i in {i for _, of in machine.iter(text) for i in of}]
            yield pd.DataFrame(rows, columns=["unit_id", "term_id"])

    return units.mapInPandas(run, f"unit_id {kind}, term_id {known}")


def _pieces(rows: DataFrame, id_: str, text: str, sizes: Sequence[int]) -> DataFrame:
    """(id, piece): the distinct pieces of each text, of each of ``sizes``; one shorter than all has none."""
    kind = rows.schema[id_].dataType.simpleString()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for i, t in zip(f[id_], f[text], strict=True):
                found = {t[a : a + n] for n in sizes for a in range(len(t) - n + 1)}
                yield pd.DataFrame({id_: [i] * len(found), "piece": list(found)})

    return rows.select(id_, text).filter(F.length(text) > 0).mapInPandas(run, f"{id_} {kind}, piece string")


def _by_pieces(units: DataFrame, terms: DataFrame) -> DataFrame:
    sizes = sorted(r[0] for r in terms.select(F.least(F.length("term"), F.lit(PIECE)).alias("n")).distinct().collect())
    in_texts = _pieces(units, "unit_id", "text", sizes)
    of_terms = terms.withColumn("n", F.least(F.length("term"), F.lit(PIECE)))
    own = None
    for n in sizes:
        of = _pieces(of_terms.filter(F.col("n") == n), "term_id", "term", [n])
        own = of if own is None else own.unionByName(of)
    often = in_texts.groupBy("piece").agg(F.count("*").alias("often"))
    rare = own.join(often, "piece").groupBy("term_id").agg(F.min_by("piece", F.struct("often", "piece")).alias("piece"))
    met = in_texts.join(rare, "piece").select("unit_id", "term_id").join(terms, "term_id").join(units, "unit_id")
    return met.filter(F.contains("text", "term")).select("unit_id", "term_id")


def term_hits(units: DataFrame, terms: DataFrame, most: int = AUTOMATON_CHARS) -> DataFrame:
    """(unit_id, term_id): the terms (term_id, term) that stand in each unit's text (unit_id, text),
    once each; ids are of one unit and one term each."""
    u = units.select("unit_id", F.lower("text").alias("text"))
    t = terms.select("term_id", F.lower("term").alias("term")).filter(F.length("term") > 0)
    chars = t.agg(F.coalesce(F.sum(F.length("term")), F.lit(0))).first()[0]
    if not chars:
        return u.join(t, F.lit(False)).select("unit_id", "term_id")
    return _by_automaton(u, t) if chars <= most else _by_pieces(u, t)


def _listed(units: DataFrame, terms: DataFrame | Sequence[tuple], *names: str) -> DataFrame:
    made = terms if isinstance(terms, DataFrame) else units.sparkSession.createDataFrame([(*t, i) for i, t in enumerate(terms)], ", ".join(f"{n} string" for n in names) + ", ord long")
    return made.select(*names, "ord")


def instructions_per_unit(units: DataFrame, terms: DataFrame | Sequence[tuple[str, str]], most: int = AUTOMATON_CHARS) -> DataFrame:
    """unit_id, source_term, target_term: the terms (source_term, target_term, ord; ord is of one term),
    either side of which stands in the unit's text or in its neighbours' (text, before, after)."""
    listed = _listed(units, terms, "source_term", "target_term")
    around = units.select("unit_id", F.concat_ws("\n", "text", "before", "after").alias("text"))
    sides = listed.select(F.explode(F.array(F.struct((F.col("ord") * 2).alias("term_id"), F.col("source_term").alias("term")), F.struct((F.col("ord") * 2 + 1).alias("term_id"), F.col("target_term").alias("term")))).alias("s")).select("s.*")
    hits = term_hits(around, sides, most).select("unit_id", F.expr("term_id div 2").alias("ord")).distinct()
    return hits.join(listed, "ord").select("unit_id", "source_term", "target_term")


def apply_terms(units: DataFrame, terms: DataFrame | Sequence[tuple[str, str, str]], most: int = AUTOMATON_CHARS) -> DataFrame:
    """Known corrections (source_term, wrong, right, ord; ord is of one correction) of targets whose
    source has the term, one after the other by ord. unit_id is of one unit."""
    listed = _listed(units, terms, "source_term", "wrong", "right")
    hits = term_hits(units.select("unit_id", F.col("source").alias("text")), listed.select(F.col("ord").alias("term_id"), F.col("source_term").alias("term")), most)
    of = hits.join(listed.withColumnRenamed("ord", "term_id"), "term_id").groupBy("unit_id").agg(F.sort_array(F.collect_list(F.struct("term_id", "wrong", "right"))).alias("_fixes"))
    mended = F.aggregate("_fixes", F.col("target"), lambda text, x: F.replace(text, x["wrong"], x["right"]))
    return units.join(of, "unit_id", "left").withColumn("target", F.when(F.col("_fixes").isNull(), F.col("target")).otherwise(mended)).drop("_fixes")
