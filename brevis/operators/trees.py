"""Constituency and dependency trees as node tables, with axes as interval joins.

A node has the interval of its leaves and its depth, so that ancestor, following
and sibling relations are comparisons on equal sentence keys.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NODE = "node_id int, parent_id int, idx int, label string, text string, leaf_lo int, leaf_hi int, depth int"
_MARK = re.compile(r"\(|\)|[^\s()]+")


def parse_brackets(s: str | None) -> list[tuple]:
    """Nodes of a bracketed tree, in preorder; a leaf has a text. Unbalanced input gives the nodes that were closed or opened so far."""
    nodes, stack, leaf, last = [], [], 0, ""
    for token in _MARK.findall(s or ""):
        if token == "(":
            parent = stack[-1] if stack else None
            node = {"id": len(nodes), "parent": nodes[parent]["id"] if parent is not None else None, "idx": nodes[parent]["kids"] if parent is not None else 0, "label": "", "text": None, "lo": leaf, "hi": leaf, "depth": len(stack), "kids": 0}
            if parent is not None:
                nodes[parent]["kids"] += 1
            nodes.append(node)
            stack.append(node["id"])
        elif token == ")":
            if stack:
                nodes[stack.pop()]["hi"] = leaf
        elif last == "(":
            nodes[stack[-1]]["label"] = token
        elif stack:
            top = nodes[stack[-1]]
            top["text"] = token if top["text"] is None else f"{top['text']} {token}"
            leaf += 1
        last = token
    for open_ in stack:
        nodes[open_]["hi"] = leaf
    return [(n["id"], n["parent"], n["idx"], n["label"], n["text"], n["lo"], n["hi"], n["depth"]) for n in nodes]


def _nodes(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for s in batches:
        yield s.map(parse_brackets)


def tree_nodes(parses: DataFrame, key: str, column: str = "parse") -> DataFrame:
    """(key, node columns) of bracketed parses, one Arrow batch of texts at a time."""
    parsed = F.pandas_udf(_nodes, f"array<struct<{', '.join(c.replace(' ', ':') for c in NODE.split(', '))}>>")
    return parses.select(key, F.explode(parsed(F.col(column))).alias("n")).select(key, "n.*")


#: Axes as conditions between a context node a and a node b of the same sentence.
AXES = {
    "child": "b.parent_id = a.node_id",
    "parent": "a.parent_id = b.node_id",
    "descendant": "b.leaf_lo >= a.leaf_lo and b.leaf_hi <= a.leaf_hi and b.depth > a.depth",
    "ancestor": "b.leaf_lo <= a.leaf_lo and b.leaf_hi >= a.leaf_hi and b.depth < a.depth",
    "following": "b.leaf_lo >= a.leaf_hi",
    "immediately_following": "b.leaf_lo = a.leaf_hi",
    "preceding": "b.leaf_hi <= a.leaf_lo",
    "immediately_preceding": "b.leaf_hi = a.leaf_lo",
    "following_sibling": "b.parent_id = a.parent_id and b.idx > a.idx",
    "immediately_following_sibling": "b.parent_id = a.parent_id and b.idx = a.idx + 1",
    "preceding_sibling": "b.parent_id = a.parent_id and b.idx < a.idx",
}
STEPS = {"/": "child", "//": "descendant", "\\": "parent", "\\\\": "ancestor", "->": "immediately_following", "-->": "following", "<-": "immediately_preceding", "<--": "preceding", "=>": "immediately_following_sibling", "==>": "following_sibling", "<==": "preceding_sibling"}
_STEP = re.compile(r"(==>|=>|<==|-->|->|<--|<-|//|/|\\\\|\\)([A-Za-z0-9_$.*-]+?)(?=(?:==>|=>|<==|-->|->|<--|<-|/|\\|$))")


def step(context: DataFrame, nodes: DataFrame, key: str, axis: str, label: str | None) -> DataFrame:
    """The nodes with a label (any if None) on an axis of the context's nodes, each once."""
    b = nodes.filter(F.col("label") == label) if label else nodes
    return b.alias("b").join(context.alias("a"), F.expr(f"a.{key} = b.{key} and {AXES[axis]}"), "left_semi")


def path_query(nodes: DataFrame, key: str, path: str) -> DataFrame:
    """Nodes that a path such as //S/NP==>VP reaches; * is any label."""
    steps = _STEP.findall(path)
    if "".join(a + b for a, b in steps) != path:
        raise ValueError(f"not a path: {path}")
    axis, label = steps[0]
    start = nodes if axis == "//" else nodes.filter("parent_id is null")
    now = start if label == "*" else start.filter(F.col("label") == label)
    for axis, label in steps[1:]:
        now = step(now, nodes, key, STEPS[axis], None if label == "*" else label)
    return now


def noun_phrases(nodes: DataFrame, leaves: DataFrame, key: str) -> DataFrame:
    """(key, node_id, np, head) of NP nodes: their leaves' words, and the last one as the head."""
    np = nodes.filter("label = 'NP'").select(key, "node_id", "leaf_lo", "leaf_hi")
    w = leaves.select(F.col(key).alias("_k"), F.col("leaf_lo").alias("at"), "text")
    j = np.join(w, (F.col(key) == F.col("_k")) & (F.col("at") >= F.col("leaf_lo")) & (F.col("at") < F.col("leaf_hi")))
    words = F.transform(F.array_sort(F.collect_list(F.struct("at", "text"))), lambda x: x["text"])
    return j.groupBy(key, "node_id").agg(words.alias("ws")).select(key, "node_id", F.array_join("ws", " ").alias("np"), F.element_at("ws", -1).alias("head"))


def shortest_variants(phrases: DataFrame) -> DataFrame:
    """(np, shortest): phrases seen twice or more, mapped to the shortest phrase with their head that they contain."""
    c = phrases.groupBy("head", "np").agg(F.count("*").alias("n")).filter("n >= 2").select("head", "np")
    short = c.select("head", F.col("np").alias("s"))
    j = c.join(short, "head").filter("np like concat('%', s)")
    return j.groupBy("np").agg(F.min(F.struct(F.length("s").alias("l"), "s")).alias("m")).select("np", F.col("m.s").alias("shortest"))


def dependency_compressions(tokens: DataFrame, key: str, least_words: int = 5) -> DataFrame:
    """(key, variant, text): a sentence without short temporal subtrees that name a weekday. tokens(key, tok_id, form, head, deprel).

    A subtree here is a TMP token with its direct dependants, three at most.
    """
    tmp = tokens.filter("deprel = 'TMP'").select(key, F.col("tok_id").alias("root"))
    sub = tmp.join(tokens, key).filter("tok_id = root or head = root").groupBy(key, "root").agg(F.count("*").alias("n"), F.bool_or(F.col("form").rlike("(Mon|Tues|Wednes|Thurs|Fri|Satur|Sun)day")).alias("day"), F.collect_set("tok_id").alias("ids")).filter("n <= 3 and day")
    drop = sub.groupBy(key).agg(F.array_distinct(F.flatten(F.collect_list("ids"))).alias("drop"))
    j = tokens.join(drop, key)
    whole = lambda keep: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(keep, F.struct("tok_id", "form")))), lambda x: x["form"]), " ")
    out = j.groupBy(key).agg(whole(~F.array_contains("drop", F.col("tok_id"))).alias("text"), F.count_if(~F.array_contains("drop", F.col("tok_id"))).alias("n"))
    return out.filter(F.col("n") >= least_words).select(key, F.lit("no_day").alias("variant"), "text")


def acronyms(text: Column) -> Column:
    """Pairs (definition, acronym) of "Some Long Name (SLN)": as many capitalised words as the acronym has letters, with these initials."""
    found = F.regexp_extract_all(text, F.lit("((?:[A-Z][a-z]+ ){2,6})\\(([A-Z]{2,6})\\)"), F.lit(0))
    pair = lambda x: F.struct(F.trim(F.regexp_extract(x, "^([^(]*)", 1)).alias("definition"), F.regexp_extract(x, "\\(([A-Z]+)\\)", 1).alias("acronym"))
    initials = lambda d: F.array_join(F.transform(F.split(d, " "), lambda w: F.substring(w, 1, 1)), "")
    return F.filter(F.transform(found, pair), lambda p: F.endswith(initials(p["definition"]), p["acronym"]))
