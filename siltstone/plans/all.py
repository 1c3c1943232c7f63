"""Imports every module of queries, which register themselves."""

from siltstone.plans import q_asof, q_checks, q_core, q_extra, q_forecasts, q_models, q_more, q_plans, q_rates, q_serve, q_space, q_time  # noqa: F401
from siltstone.plans.catalogue import QUERIES, SQL


def queries():
    return QUERIES


def oracle_sql():
    return SQL
