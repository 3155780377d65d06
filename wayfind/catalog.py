"""Registered queries of the sign-takeoff operators, each with its SQL twin."""

from __future__ import annotations

from wayfind.plans import buildings, cleaning, drawings, imports, layout, matching, reviews, rules, ruling, schedules, sheets, takeoff, trends

_AREAS = (rules, ruling, matching, takeoff, buildings, sheets, reviews, layout, cleaning, schedules, drawings, trends, imports)


def flagship(spark, sf_dir):
    return rules.QUERIES["e16_apply_rules"][0](spark, sf_dir)


def queries():
    return {name: run for area in _AREAS for name, (run, _) in area.QUERIES.items()}


def oracle_sql():
    return {name: sql for area in _AREAS for name, (_, sql) in area.QUERIES.items() if sql}
