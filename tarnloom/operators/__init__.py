"""The ten operators by name; each takes (catalog, inputs, step) and gives a lazy result."""

from .base import Candidates, Operator, Result
from .conflicts import conflict_resolve
from .dedup import dedup
from .filters import filter_
from .mapping import category_map
from .override import manual_override
from .sets import except_, intersect, union
from .sources import import_list, source

OPERATORS: dict[str, Operator] = {
    "source": source,
    "import_list": import_list,
    "union": union,
    "intersect": intersect,
    "except": except_,
    "filter": filter_,
    "dedup": dedup,
    "category_map": category_map,
    "conflict_resolve": conflict_resolve,
    "manual_override": manual_override,
}

__all__ = ["OPERATORS", "Candidates", "Operator", "Result"]
