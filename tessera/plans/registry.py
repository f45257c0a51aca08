"""Named builders with bounded parameters: how callers reach the operators by name."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame


def bounded_int(value: object, low: int, high: int, fallback: int) -> int:
    """A whole number within bounds; anything but a finite number or its text gives the fallback."""
    if isinstance(value, bool) or not isinstance(value, (int, float, str)):
        return fallback
    try:
        number = float(value)
    except ValueError:
        return fallback
    return min(high, max(low, math.floor(number))) if math.isfinite(number) else fallback


def cap_text(text: str, limit: int = 100_000) -> str:
    return text if len(text) <= limit else f"{text[:limit]}\n… {len(text) - limit} more characters truncated"


def cap_lines(lines: list[str], limit: int) -> list[str]:
    return lines if len(lines) <= limit else [*lines[:limit], f"… {len(lines) - limit} more matches truncated"]


@dataclass
class Registry:
    """Builders by name. A parameter with bounds (low, high, fallback) is always brought within them."""

    builders: dict[str, Callable[..., DataFrame]] = field(default_factory=dict)
    bounds: dict[str, dict[str, tuple[int, int, int]]] = field(default_factory=dict)
    aliases: dict[str, str] = field(default_factory=dict)

    def add(self, name: str, builder: Callable[..., DataFrame], bounds: dict[str, tuple[int, int, int]] | None = None, *aliases: str) -> None:
        if name in self.builders or name in self.aliases:
            raise ValueError(f"{name} is taken")
        self.builders[name] = builder
        self.bounds[name] = bounds or {}
        self.aliases |= {a: name for a in aliases}

    def build(self, name: str, *args: object, **params: object) -> DataFrame:
        name = self.aliases.get(name, name)
        if name not in self.builders:
            raise KeyError(f"no operator is called {name}")
        limits = {k: bounded_int(params.get(k), *b) for k, b in self.bounds[name].items()}
        return self.builders[name](*args, **{**params, **limits})


def default_registry() -> Registry:
    from tessera.functions import prose
    from tessera.operators import budget, context, diff, evaluate, failures, graph, hierarchy, inverted, memory, retrieval
    from tessera.sources import extract, git, markers, memory_files, tree

    r = Registry()
    r.add("search", retrieval.search_symbols, {"limit": (1, 200, 30)})
    r.add("context", context.hybrid_results, {"limit": (1, 200, 30)})
    r.add("context_baseline", context.baseline_tokens)
    r.add("index_search", inverted.search_indexed, {"limit": (1, 200, 30)})
    r.add("index_memory_search", inverted.indexed_topk, {"limit": (1, 100, 10)})
    r.add("extract", extract.extract_symbols, None, "index")
    r.add("reexports", extract.extract_reexports)
    r.add("list_files", tree.list_files)
    r.add("walk", tree.walk, {"depth": (1, 20, 5)})
    r.add("grep", tree.grep, {"per_file": (1, 1000, 50)})
    r.add("read_file", tree.line_range)
    r.add("changed_files", git.changed_files)
    r.add("history", git.history, {"limit": (1, 100, 5)})
    r.add("compress", prose.compressed)
    r.add("truncate", budget.truncated, {"budget": (0, 1_000_000, 8000)})
    r.add("pack", budget.pack_context, {"budget": (100, 1_000_000, 8000)})
    r.add("memory_list", memory.list_memories)
    r.add("memory_get", memory.get_memory)
    r.add("memory_delete", memory.delete)
    r.add("memory_invalidate", memory.invalidate)
    r.add("memory_import", memory.imported_docs)
    r.add("memory_export", memory_files.export_tree)
    r.add("session_export", memory_files.session_sections, {"max_memories": (1, 1000, 15)})
    r.add("session_import", memory_files.parse_session)
    r.add("failure_guard", failures.guard_batch)
    r.add("failure_records", failures.failure_records)
    r.add("failure_settled", failures.settled_records)
    r.add("evaluate", evaluate.deltas)
    r.add("graph_neighbours", graph.neighbours, {"limit": (1, 100, 6)})
    r.add("graph_detail", graph.node_detail, {"limit": (1, 100, 12)})
    r.add("graph_build", graph.build_edges)
    r.add("memory_search", retrieval.bm25_topk, {"limit": (1, 100, 10)})
    r.add("memory_recall", memory.recall, {"limit": (1, 100, 20)})
    r.add("memory_status", memory.status)
    r.add("memory_mine", memory.mine_windows, {"per_text": (1, 1000, 20)})
    r.add("graph_hubs", graph.hubs, {"limit": (1, 100, 10)}, "graph_report")
    r.add("graph_reach", graph.reach, {"depth": (1, 20, 5)}, "graph_query")
    r.add("graph_path", graph.shortest_path, {"depth": (1, 50, 20)})
    r.add("impact", graph.impact, {"depth": (1, 5, 2)})
    r.add("review_pack", diff.review_pack, {"max_files": (1, 1000, 20)})
    r.add("debt_markers", markers.debt_markers, None, "debt_ledger")
    r.add("hierarchy", hierarchy.resolve_hierarchy)
    return r
