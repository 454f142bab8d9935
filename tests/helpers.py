"""Comparing results."""

from decimal import Decimal


def plain(v):
    return float(v) if isinstance(v, Decimal) else v


def rows_of(df):
    names = sorted(df.columns)
    return names, sorted((tuple(plain(r[n]) for n in names) for r in df.collect()), key=repr)


def rows_of_sql(duck, sql):
    cursor = duck.execute(sql)
    found = [d[0] for d in cursor.description]
    names = sorted(found)
    return names, sorted((tuple(plain(r[found.index(n)]) for n in names) for r in cursor.fetchall()), key=repr)
