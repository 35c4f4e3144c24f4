"""Tenant / user / project scope rules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed pattern: one scope segment.
SEGMENT = r"^[A-Za-z0-9][A-Za-z0-9._-]{0,62}$"


def scope_key(tenant: Column, user: Column, project: Column) -> Column:
    """tenant/user/project, with * standing for all projects."""
    return F.concat_ws("/", tenant, user, F.coalesce(project, F.lit("*")))


def parse_scope_header(header: Column) -> Column:
    """struct(tenant, user_id, project, error); error is null for a well-formed header."""
    parts = F.split(header, "/", -1)
    tenant, user, raw = (F.try_element_at(parts, F.lit(i)) for i in (1, 2, 3))
    project = F.when((raw == "*") | (raw == ""), None).otherwise(raw)
    error = (
        F.when(header.isNull() | (header == ""), "header is required")
        .when(F.size(parts) != 3, "must be tenant/user/project")
        .when(~tenant.rlike(SEGMENT), "bad tenant")
        .when(~user.rlike(SEGMENT), "bad user")
        .when(project.isNotNull() & ~project.rlike(SEGMENT), "bad project")
    )
    ok = error.isNull()
    return F.struct(
        F.when(ok, tenant).alias("tenant"),
        F.when(ok, user).alias("user_id"),
        F.when(ok, project).alias("project"),
        error.alias("error"),
    )


def write_scope_error(parsed: Column) -> Column:
    """Reads may span projects; writes must pin one."""
    return F.coalesce(
        parsed["error"],
        F.when(parsed["project"].isNull(), F.lit("project is required for writes")),
    )


def scope_contains(outer: dict[str, Column], inner: dict[str, Column]) -> Column:
    return (
        (outer["tenant"] == inner["tenant"])
        & (outer["user_id"] == inner["user_id"])
        & (outer["project"].isNull() | outer["project"].eqNullSafe(inner["project"]))
    )


def same_scope(a: dict[str, Column], b: dict[str, Column]) -> Column:
    return (
        (a["tenant"] == b["tenant"])
        & (a["user_id"] == b["user_id"])
        & a["project"].eqNullSafe(b["project"])
    )


def grant_project(requested: Column, allowed: Column) -> Column:
    """struct(project, denied) for a requested project against a list of granted ones."""
    grants = F.coalesce(allowed, F.array(F.lit("*")))
    wildcard = F.array_contains(grants, "*")
    unnamed = requested.isNull() | (requested == "")
    denied = (
        F.when(unnamed & ~wildcard & (F.size(grants) == 0), "token grants no projects")
        .when(~unnamed & ~wildcard & ~F.array_contains(grants, requested), "project not granted")
    )
    project = (
        F.when(unnamed & wildcard, None)
        .when(unnamed, F.try_element_at(grants, F.lit(1)))
        .otherwise(requested)
    )
    return F.struct(F.when(denied.isNull(), project).alias("project"), denied.alias("denied"))
