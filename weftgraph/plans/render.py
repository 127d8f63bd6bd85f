"""Bounded results as nested dicts and as text trees."""

from __future__ import annotations

import re

from ..operators.traverse import Tree


def tree_dict(tree: Tree) -> dict:
    return {"symbol": tree.symbol, "depth": tree.depth, "direct_callers": tree.direct_callers, "total_usages": tree.total_usages, "callers": [tree_dict(c) for c in tree.callers]}


def location(uri: str | None, line: int | None) -> str:
    """`File.java:12` of a uri; the line of the uri itself counts where none is given."""
    name, own = re.search(r"([^/:]*)(?::(\d+))?$", uri or "").groups()
    shown = line if line and line > 0 else own
    return f"{name}:{shown}" if shown else name


def _branches(rows: list[dict], lead: str) -> list[str]:
    out = []
    for i, row in enumerate(rows):
        last = i + 1 == len(rows)
        out.append(f"{lead}{'└── ' if last else '├── '}{row.get('caller_symbol') or '?'} ({location(row.get('caller_uri'), row.get('caller_line'))})")
        inner = lead + ("    " if last else "│   ")
        out += _branches(row.get("children", []), inner)
        if row.get("children_truncated"):
            out.append(f"{inner}… {row['children_total'] - row['children_displayed']} more")
    return out


def usages_text(symbol: str, page: dict) -> str:
    """A page of usages: declarations first, then callers as a tree, and how many more there are."""
    declared = [r for r in page["results"] if r.get("usage_type") == "java_declaration"]
    used = [r for r in page["results"] if r.get("usage_type") != "java_declaration"]
    lines = [f"{symbol}: {page['total']} usages"]
    lines += [f"declared in {location(r.get('caller_uri'), r.get('caller_line'))}" for r in declared]
    lines += _branches(used, "")
    if page.get("has_more"):
        lines.append(f"… {page['total'] - page['offset'] - len(page['results'])} more from offset {page['next_offset']}")
    return "\n".join(lines)


def impact_text(tree: dict, lead: str = "") -> str:
    lines = [f"{tree['symbol']} ({tree['total_usages']} usages)"] if not lead else []
    for i, child in enumerate(tree["callers"]):
        last = i + 1 == len(tree["callers"])
        lines.append(f"{lead}{'└── ' if last else '├── '}{child['symbol']} ({child['total_usages']} usages)")
        if below := impact_text(child, lead + ("    " if last else "│   ")):
            lines.append(below)
    return "\n".join(lines)
