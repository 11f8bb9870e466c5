"""Query trees as predicates over the views of a path and its name."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.paths import as_view, fold, folded, last_suffix
from . import patterns
from .syntax import And, Extension, Node, Not, Or, Term


def predicate(node: Node, name: Column, path: Column) -> Column:
    if isinstance(node, Term):
        target = path if node.whole_path else name
        return patterns.regex(target, node.pattern, node.fold) if node.regex else patterns.glob(target, node.pattern, node.fold)
    if isinstance(node, Extension):
        return F.coalesce(fold(last_suffix(name)).isin(*{folded(as_view(x)) for x in node.names}), F.lit(False))
    if isinstance(node, Not):
        return ~predicate(node.inner, name, path)
    left, right = predicate(node.left, name, path), predicate(node.right, name, path)
    return left & right if isinstance(node, And) else left | right


def by_name_alone(node: Node) -> bool:
    if isinstance(node, Term):
        return not node.whole_path
    if isinstance(node, Extension):
        return True
    return by_name_alone(node.inner) if isinstance(node, Not) else by_name_alone(node.left) and by_name_alone(node.right)


def name_filter(node: Node, name: Column) -> Column | None:
    """What every match must satisfy by its name, or None; lets a scan drop rows before it builds their paths."""
    if by_name_alone(node):
        return predicate(node, name, name)
    if isinstance(node, And):
        parts = [x for x in (name_filter(node.left, name), name_filter(node.right, name)) if x is not None]
        return reduce(lambda a, b: a & b, parts) if parts else None
    if isinstance(node, Or):
        left, right = name_filter(node.left, name), name_filter(node.right, name)
        return None if left is None or right is None else left | right
    return None
