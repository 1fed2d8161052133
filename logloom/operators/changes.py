"""A change feed applied to an empty table, column by column."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame


def _name(column: str) -> str:
    return "`" + column.replace("`", "``") + "`"


def distinct_changes(
    feed: DataFrame, key: str, change: str, order: str, fields: Sequence[str]
) -> DataFrame:
    """One row for each change of the feed, with the lowest ``order`` among its copies.

    Each field ``f`` is followed by ``f_set``, whether it isn't NULL, so that who only asks that
    doesn't move the values. Copies agree in ``key`` and ``fields``; should they not, they count as
    one change for each key, and the smallest value of a field that is set counts. Rows without
    ``key`` or ``change`` hold no record and are left out. A NULL ``order`` counts only if all
    copies have it.
    """
    picked = "".join(
        f", min({_name(f)}) AS {_name(f)}, bool_or({_name(f)} IS NOT NULL) AS {_name(f + '_set')}" for f in fields
    )
    return feed.sparkSession.sql(
        f"""
        SELECT {_name(key)}, {_name(change)}, min({_name(order)}) AS {_name(order)}{picked}
        FROM {{feed}}
        WHERE {_name(key)} IS NOT NULL AND {_name(change)} IS NOT NULL
        GROUP BY {_name(key)}, {_name(change)}
        """,
        feed=feed,
    )


def apply_changes(
    changes: DataFrame,
    key: str,
    order: Sequence[str],
    fields: Mapping[str, tuple[str, str]],
    deletes: str,
    replaces: str = "false",
) -> DataFrame:
    """The table after all changes, in SQL: one row for each key that is live.

    ``order``: the columns that order the changes of a key; NULL comes first.
    ``fields``: for each field of the table the SQL of its value in a change and the SQL
    condition under which a change sets it.
    ``deletes`` and ``replaces``: SQL conditions. A delete ends the row. A replacement ends the
    row and starts a new one from what it sets itself. A change that is both is a delete.

    For each field, the last change that sets it wins (``max_by``), if it comes after the last
    delete and not before the last replacement of its key; else the field is NULL. A key is
    live if any change that isn't a delete comes after its last delete; changes that tie in all
    of ``order`` with a delete lose to it, and of two changes that tie the larger value wins.
    Repeated changes make no difference, nor does the order of arrival.

    All is one aggregate of mergeable states. Each task combines the changes of a key before
    the shuffle, so a key with a third of all changes moves as one row for each task.
    """
    at = "struct(" + ", ".join(_name(c) for c in order) + ")"
    delete, replace = f"coalesce({deletes}, false)", f"coalesce({replaces}, false)"
    states = "".join(
        f""",
            max(CASE WHEN NOT d AND coalesce(s{n}, false) THEN at END) AS at{n},
            max_by(v{n}, struct(at, v{n})) FILTER (WHERE NOT d AND coalesce(s{n}, false)) AS f{n}"""
        for n in range(len(fields))
    )
    inputs = "".join(f", {v} AS v{n}, {s} AS s{n}" for n, (v, s) in enumerate(fields.values()))
    outputs = "".join(
        f""",
        CASE WHEN (gone IS NULL OR at{n} > gone) AND (anew IS NULL OR at{n} >= anew)
             THEN f{n} END AS {_name(f)}"""
        for n, f in enumerate(fields)
    )
    return changes.sparkSession.sql(
        f"""
        WITH seen AS (
            SELECT {_name(key)} AS k, {at} AS at, {delete} AS d, {replace} AS r{inputs}
            FROM {{changes}}
        ), state AS (
            SELECT k,
            max(CASE WHEN d THEN at END) AS gone,
            max(CASE WHEN r AND NOT d THEN at END) AS anew,
            max(CASE WHEN NOT d THEN at END) AS alive{states}
            FROM seen GROUP BY k
        )
        SELECT k AS {_name(key)}{outputs}
        FROM state
        WHERE alive IS NOT NULL AND (gone IS NULL OR alive > gone)
        """,
        changes=changes,
    )


def rebuild_store(feed: DataFrame) -> DataFrame:
    """What a store that starts empty holds after the feed: ``key, value, tstamp, change_no``.

    ``value`` NULL deletes the key and any other value, the empty one too, replaces what the key
    holds. Changes of a key take effect by ``tstamp``, then ``change_no``.
    """
    changes = distinct_changes(feed, "key", "change_no", "tstamp", ["value"])
    return apply_changes(
        changes,
        "key",
        ["tstamp", "change_no"],
        {c: (c, "value_set") for c in ("value", "tstamp", "change_no")},
        deletes="NOT value_set",
        replaces="value_set",
    )
