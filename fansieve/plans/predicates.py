"""One query per predicate, on events and on orders with list attributes."""

from __future__ import annotations

from fansieve.functions.predicates import Predicate, attr
from fansieve.plans.data import EVENTS, ORDER_EVENTS, events, order_events

user, kind, value, flag = attr("user_id"), attr("event_type"), attr("value"), attr("flag")
flags, numbers, suppliers = attr("flags"), attr("numbers"), attr("suppliers")

# name: (predicate, the same condition for the check)
ON_EVENTS: dict[str, tuple[Predicate, str]] = {
    "pred_eq": ((user == 42) | (kind == "view") | (value == 37.5), "user_id = 42 or event_type = 'view' or value = 37.5"),
    "pred_ne": ((kind != "view") & (user != 42), "event_type <> 'view' and user_id <> 42"),
    "pred_lt": ((value < 12.5) | (user < 3), "value < 12.5 or user_id < 3"),
    "pred_le": (value <= 36.29, "value <= 36.29"),
    "pred_gt": ((value > 100) | (user > 140), "value > 100 or user_id > 140"),
    "pred_ge": (value >= 58.37, "value >= 58.37"),
    "pred_truthy": (flag.is_true(), "flag"),
    "pred_and": ((user > 10) & (value > 1.0), "user_id > 10 and value > 1.0"),
    "pred_or": ((user > 140) | (kind == "purchase"), "user_id > 140 or event_type = 'purchase'"),
    "pred_not": (~((user > 10) & flag.is_true()), "not (user_id > 10 and flag)"),
    "pred_nested": (
        (((user > 10) & (value > 80.0)) | (kind == "error")) & ~(flag.is_true() | value.is_null()),
        "((user_id > 10 and value > 80.0) or event_type = 'error') and not (flag or value is null)",
    ),
    "pred_in": (user.isin(1, 2, 3) | kind.isin("view", "click"), "user_id in (1, 2, 3) or event_type in ('view', 'click')"),
    "pred_not_in": (user.not_in(1, 2, 3) & kind.not_in("view", "click"), "user_id not in (1, 2, 3) and event_type not in ('view', 'click')"),
    "pred_is_null": (value.is_null() | flag.is_null(), "value is null or flag is null"),
    "pred_is_not_null": (value.is_not_null() & user.is_not_null(), "value is not null and user_id is not null"),
}
ON_ORDERS: dict[str, tuple[Predicate, str]] = {
    "pred_is_empty": (numbers.is_empty(), "len(numbers) = 0"),
    "pred_is_not_empty": (numbers.is_not_empty() & flags.is_not_empty(), "len(numbers) > 0 and len(flags) > 0"),
    "pred_one_of": (flags.one_of("A", "N") & numbers.one_of(1, 4), "list_has_any(flags, ['A', 'N']) and list_has_any(numbers, [1, 4])"),
    "pred_none_of": (flags.none_of("R") | numbers.none_of(2, 3), "not list_has_any(flags, ['R']) or not list_has_any(numbers, [2, 3])"),
    "pred_all_of": (flags.all_of("A", "N") | numbers.all_of(1, 2), "list_has_all(flags, ['A', 'N']) or list_has_all(numbers, [1, 2])"),
}


def _events_where(predicate: Predicate):
    return lambda spark, sf_dir: events(spark, sf_dir).where(predicate.column()).select("event_id", "user_id", "event_type", "value")


def _orders_where(predicate: Predicate):
    return lambda spark, sf_dir: order_events(spark, sf_dir).where(predicate.column()).select("order_id", "revenue")


def queries():
    return {n: _events_where(p) for n, (p, _) in ON_EVENTS.items()} | {n: _orders_where(p) for n, (p, _) in ON_ORDERS.items()}


def oracle_sql():
    on_events = {n: f"SELECT event_id, user_id, event_type, value FROM ({EVENTS}) e WHERE {c}" for n, (_, c) in ON_EVENTS.items()}
    return on_events | {n: f"SELECT order_id, revenue FROM ({ORDER_EVENTS}) e WHERE {c}" for n, (_, c) in ON_ORDERS.items()}
