"""Trees made from the benchmark's texts: node tables, axes, phrases, grammar rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from brevis.functions import text as T
from brevis.operators import trees as N
from brevis.sources.tables import table

from .registry import fixed, query


def _parses(spark, d):
    """A tree per item: a noun phrase of the first two words, and a verb phrase of the third with a noun phrase of the next two."""
    w = F.split(T.fix_text(F.col("text")), " ")
    leaf = lambda tag, i: F.concat(F.lit(f"({tag} "), F.get(w, F.lit(i)), F.lit(")"))
    parse = F.concat(F.lit("(S (NP "), leaf("DT", 0), F.lit(" "), leaf("NN", 1), F.lit(") (VP "), leaf("VB", 2), F.lit(" (NP "), leaf("DT", 3), F.lit(" "), leaf("NN", 4), F.lit(")))"))
    return table(spark, d, "benchmark").filter(F.size(w) >= 5).select("item_id", parse.alias("parse"))


def _nodes(spark, d):
    return N.tree_nodes(_parses(spark, d), "item_id")


_SHAPE = "(VALUES (0, NULL, 0, 'S', 0, 5, 0), (1, 0, 0, 'NP', 0, 2, 1), (2, 1, 0, 'DT', 0, 1, 2), (3, 1, 1, 'NN', 1, 2, 2), (4, 0, 1, 'VP', 2, 5, 1), (5, 4, 0, 'VB', 2, 3, 2), (6, 4, 1, 'NP', 3, 5, 2), (7, 6, 0, 'DT', 3, 4, 3), (8, 6, 1, 'NN', 4, 5, 3)) s(node_id, parent_id, idx, label, leaf_lo, leaf_hi, depth)"
_B = f"b AS (SELECT item_id, string_split({fixed('text')}, ' ') AS w FROM benchmark), n AS (SELECT item_id, s.*, CASE WHEN leaf_hi = leaf_lo + 1 THEN w[leaf_lo + 1] END AS text FROM b, {_SHAPE} WHERE len(w) >= 5)"


@query(f"WITH {_B} SELECT item_id, node_id, coalesce(parent_id, -1) AS parent_id, idx, label, coalesce(text, '') AS text, leaf_lo, leaf_hi, depth FROM n")
def tree_node_table(spark, d):
    return _nodes(spark, d).na.fill(-1, ["parent_id"]).na.fill("", ["text"])


def _axis(name: str, path: str, where: str):
    def f(spark, d):
        return N.path_query(_nodes(spark, d), "item_id", path).select("item_id", "node_id", "label")

    f.__name__ = name
    query(f"WITH {_B} SELECT DISTINCT x.item_id, x.node_id, x.label FROM n x JOIN n a ON a.item_id = x.item_id WHERE {where}")(f)


_axis("tree_children", "//VP/NP", "a.label = 'VP' AND x.label = 'NP' AND x.parent_id = a.node_id")
_axis("tree_descendants", "//S//NN", "a.label = 'S' AND x.label = 'NN' AND x.leaf_lo >= a.leaf_lo AND x.leaf_hi <= a.leaf_hi AND x.depth > a.depth")
_axis("tree_following", "//VB-->NN", "a.label = 'VB' AND x.label = 'NN' AND x.leaf_lo >= a.leaf_hi")
_axis("tree_siblings", "//NP==>VP", "a.label = 'NP' AND x.label = 'VP' AND x.parent_id = a.parent_id AND x.idx > a.idx")
_axis("tree_ancestors", "//NN\\\\VP", "a.label = 'NN' AND x.label = 'VP' AND x.leaf_lo <= a.leaf_lo AND x.leaf_hi >= a.leaf_hi AND x.depth < a.depth")


@query(f"WITH {_B}, r AS (SELECT p.item_id, p.node_id, p.label AS lhs, string_agg(c.label, ' ' ORDER BY c.idx) AS rhs FROM n p JOIN n c ON c.item_id = p.item_id AND c.parent_id = p.node_id GROUP BY ALL), k AS (SELECT lhs, rhs, count(*) AS n FROM r GROUP BY ALL) SELECT lhs, rhs, n, round(n / sum(n) OVER (PARTITION BY lhs), 9) AS p FROM k")
def induce_grammar(spark, d):
    """Rules of the trees with their probabilities."""
    n = _nodes(spark, d)
    kids = n.filter("parent_id is not null").groupBy("item_id", "parent_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("idx", "label"))), lambda x: x["label"]), " ").alias("rhs"))
    r = kids.join(n.select("item_id", F.col("node_id").alias("parent_id"), F.col("label").alias("lhs")), ["item_id", "parent_id"]).groupBy("lhs", "rhs").agg(F.count("*").alias("n"))
    t = r.groupBy("lhs").agg(F.sum("n").alias("t"))
    return r.join(t, "lhs").select("lhs", "rhs", "n", F.round(F.col("n") / F.col("t"), 9).alias("p"))


@query(f"WITH {_B} SELECT item_id, node_id, w AS np, text AS head FROM (SELECT a.item_id, a.node_id, (SELECT string_agg(l.text, ' ' ORDER BY l.leaf_lo) FROM n l WHERE l.item_id = a.item_id AND l.text IS NOT NULL AND l.leaf_lo >= a.leaf_lo AND l.leaf_lo < a.leaf_hi) AS w, (SELECT l.text FROM n l WHERE l.item_id = a.item_id AND l.text IS NOT NULL AND l.leaf_hi = a.leaf_hi) AS text FROM n a WHERE a.label = 'NP')")
def noun_phrase_heads(spark, d):
    n = _nodes(spark, d)
    return N.noun_phrases(n, n.filter("text is not null"), "item_id")


@query(None)
def np_mapping(spark, d):
    n = _nodes(spark, d)
    return N.shortest_variants(N.noun_phrases(n, n.filter("text is not null"), "item_id").select("np", "head"))


@query(None)
def acronym_definitions(spark, d):
    return table(spark, d, "documents").select("doc_id", F.explode(N.acronyms(F.col("text"))).alias("a")).select("doc_id", "a.*")
