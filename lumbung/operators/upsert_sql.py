"""Statements that insert or upsert: one row with parameters, or all rows of a staging table.

Without key columns the statement is a plain insert. If every column is a key there is nothing to
update, and the statement leaves an existing row alone. Each column is a parameter once, in order.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from lumbung.sources.jdbc import dialect


def _quoted(columns: Sequence[str], q: str) -> list[str]:
    return [f"{q}{c}{q}" for c in columns]


def _insert(table: str, columns: Sequence[str], q: str, verb: str = "INSERT") -> str:
    return f"{verb} INTO {table} ({', '.join(_quoted(columns, q))}) VALUES ({', '.join(f':{c}' for c in columns)})"


def _on_conflict(table: str, columns: Sequence[str], keys: Sequence[str], rest: Sequence[str]) -> str:
    action = "DO UPDATE SET " + ", ".join(f'"{c}" = EXCLUDED."{c}"' for c in rest) if rest else "DO NOTHING"
    return f"{_insert(table, columns, chr(34))} ON CONFLICT ({', '.join(_quoted(keys, chr(34)))}) {action}"


def _on_duplicate_key(table: str, columns: Sequence[str], keys: Sequence[str], rest: Sequence[str]) -> str:
    if not rest:
        return _insert(table, columns, "`", "INSERT IGNORE")
    return f"{_insert(table, columns, '`')} ON DUPLICATE KEY UPDATE {', '.join(f'`{c}` = VALUES(`{c}`)' for c in rest)}"


def _merge(one_row: str, on: str, end: str) -> Callable[[str, Sequence[str], Sequence[str], Sequence[str]], str]:
    def statement(table: str, columns: Sequence[str], keys: Sequence[str], rest: Sequence[str]) -> str:
        row = one_row.format(", ".join(f':{c} AS "{c}"' for c in columns))
        parts = [f"MERGE INTO {table} target USING {row} source ON", on.format(" AND ".join(f'target."{k}" = source."{k}"' for k in keys))]
        if rest:
            parts.append("WHEN MATCHED THEN UPDATE SET " + ", ".join(f'target."{c}" = source."{c}"' for c in rest))
        parts.append(f"WHEN NOT MATCHED THEN INSERT ({', '.join(_quoted(columns, chr(34)))}) VALUES ({', '.join(f'source.{c}' for c in _quoted(columns, chr(34)))})")
        return " ".join(parts) + end

    return statement


_UPSERTS = {
    "postgres": _on_conflict,
    "sqlite": _on_conflict,
    "mysql": _on_duplicate_key,
    "mariadb": _on_duplicate_key,
    "mssql": _merge("(SELECT {})", "{}", ";"),
    "oracle": _merge("(SELECT {} FROM DUAL)", "({})", ""),
}


def upsert_sql(db_type: str, table: str, columns: Sequence[str], keys: Sequence[str] | None = None) -> str:
    """ValueError if the database has no upsert of one row, or a key isn't among the columns. Parameters are named like columns."""
    name = db_type.lower()
    if not keys:
        return _insert(table, columns, "`" if name in ("mysql", "mariadb") else '"')
    if unknown := [k for k in keys if k not in columns]:
        raise ValueError(f"keys that are no columns: {', '.join(unknown)}")
    if dialect(name).name not in _UPSERTS:
        raise ValueError(f"no upsert for: {db_type}")
    return _UPSERTS[name](table, columns, keys, [c for c in columns if c not in keys])


#: How drivers mark the parameter of a place and name it in the values they are given (PEP 249).
_STYLES: dict[str, Callable[[int], str]] = {
    "named": lambda i: f":p{i}",
    "pyformat": lambda i: f"%(p{i})s",
    "qmark": lambda i: "?",
    "format": lambda i: "%s",
    "numeric": lambda i: f":{i + 1}",
}


def bound_sql(db_type: str, table: str, columns: Sequence[str], keys: Sequence[str] | None, style: str) -> tuple[str, bool]:
    """``upsert_sql`` with the parameters of a driver's ``paramstyle``, and whether it takes values by name (``p0``, ``p1``…)."""
    if style not in _STYLES:
        raise ValueError(f"unknown parameter style: {style}")
    marks = [f"\x00{i}\x00" for i in range(len(columns))]
    sql = upsert_sql(db_type, table, columns, keys)
    for mark, column in sorted(zip(marks, columns), key=lambda x: -len(x[1])):  # no name that begins another goes first
        sql = sql.replace(f":{column}", mark)
    if style in ("pyformat", "format"):
        sql = sql.replace("%", "%%")
    for i, mark in enumerate(marks):
        sql = sql.replace(mark, _STYLES[style](i))
    return sql, style in ("named", "pyformat")


def staged_sql(db_type: str, table: str, staging: str, columns: Sequence[str], names: Sequence[str], keys: Sequence[str]) -> list[str]:
    """Statements that bring the rows of ``staging`` into ``table`` by key; ``names`` are the table's names of ``columns``.

    Rows that are there are updated in the given columns, others inserted. A database without
    transactions gets whole rows: the old ones are deleted first. One that joins large tables by an index or
    in nested loops only gets an index of the staged keys, and finds those that aren't there by sorting.
    """
    d = dialect(db_type)
    q = lambda c: f"{d.quote}{c}{d.quote}"
    of = dict(zip(columns, names))
    into, given = ", ".join(q(of[c]) for c in columns), ", ".join(f"s.{q(c)}" for c in columns)
    if not d.transactions:
        there, here = ", ".join(q(of[k]) for k in keys), ", ".join(q(k) for k in keys)
        return [f"ALTER TABLE {table} DELETE WHERE ({there}) IN (SELECT {here} FROM {staging}) SETTINGS mutations_sync = 2", f"INSERT INTO {table} ({into}) SELECT {given} FROM {staging} s"]
    same = " AND ".join(f"{table}.{q(of[k])} = s.{q(k)}" for k in keys)
    rest = [c for c in columns if c not in keys]
    inserts = [f"INSERT INTO {table} ({into}) SELECT {given} FROM {staging} s WHERE NOT EXISTS (SELECT 1 FROM {table} WHERE {same})"]
    first = []
    if d.nested_loops:
        here, there = ", ".join(q(k) for k in keys), ", ".join(q(of[k]) for k in keys)
        first = [f"CREATE INDEX {staging}_k ON {staging} ({here})"]
        absent = f"(SELECT {here} FROM {staging} EXCEPT SELECT {there} FROM {table}) n"
        found, null = " AND ".join(f"s.{q(k)} = n.{q(k)}" for k in keys), " OR ".join(f"s.{q(k)} IS NULL" for k in keys)
        inserts = [  # nulls are equal to EXCEPT; the hint ends with its line
            f"INSERT INTO {table} ({into}) SELECT {given} FROM --DERBY-PROPERTIES joinOrder=FIXED\n{absent}, {staging} s WHERE {found}",
            f"INSERT INTO {table} ({into}) SELECT {given} FROM {staging} s WHERE {null}",
        ]
    if not rest:
        return [*first, *inserts]
    values = ", ".join(f"{q(of[c])} = (SELECT s.{q(c)} FROM {staging} s WHERE {same})" for c in rest)
    return [*first, f"UPDATE {table} SET {values} WHERE EXISTS (SELECT 1 FROM {staging} s WHERE {same})", *inserts]
