"""Queries from request parameters and from the state of a table on a page, and back."""

from __future__ import annotations

OPERATORS = {"eq": "==", "neq": "!=", "gt": ">", "gte": ">=", "lt": "<", "lte": "<="}


def coerce(text: str):
    """true, false and numbers by their looks, anything else as text."""
    if text in ("true", "false"):
        return text == "true"
    try:
        return float(text) if text.strip() else text
    except ValueError:
        return text


def from_params(query, params: dict):
    """where=field:op:value (repeated), orderBy=field[:desc], limit, offset."""
    where = params.get("where", [])
    for part in [where] if isinstance(where, str) else where:
        path, op, value = part.split(":", 2)
        if op not in OPERATORS:
            raise ValueError(f"no operator {op!r}")
        query = query.where(path, OPERATORS[op], coerce(value))
    if order := params.get("orderBy"):
        path, _, direction = order.partition(":")
        query = query.order_by(path, direction or "asc")
    if "offset" in params:
        query = query.offset(int(params["offset"]))
    return query.limit(int(params["limit"])) if "limit" in params else query


def from_table_state(query, state: dict):
    """Column filters (lists: in, scalars: ==, empty ones left out), sorting, pagination."""
    for f in state.get("columnFilters", []):
        value = f["value"]
        if isinstance(value, (list, tuple)):
            query = query.where(f["id"], "in", list(value)) if value else query
        elif value not in (None, ""):
            query = query.where(f["id"], "==", value)
    for key in state.get("sorting", []):
        query = query.order_by(key["id"], "desc" if key.get("desc") else "asc")
    if page := state.get("pagination"):
        query = query.offset(page["pageIndex"] * page["pageSize"]).limit(page["pageSize"])
    return query


def to_table_state(query) -> dict:
    """The state that from_table_state would read; clauses it cannot show are left out."""
    plan = query.plan.to_dict()
    shown = [c for c in plan["clauses"] if c["type"] == "field" and c["op"] in ("==", "in")]
    state: dict = {"columnFilters": [{"id": c["field"], "value": c["value"]} for c in shown], "sorting": [{"id": o["field"], "desc": o["direction"] == "desc"} for o in plan["orderBy"]]}
    if plan["limit"]:
        state["pagination"] = {"pageIndex": plan["offset"] // plan["limit"], "pageSize": plan["limit"]}
    return state
