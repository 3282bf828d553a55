"""Comparison of rows between engines."""


def rows_of(cursor, names):
    at = [[d[0] for d in cursor.description].index(n) for n in names]
    return sorted((tuple(r[i] for i in at) for r in cursor.fetchall()), key=repr)


def agree(a, b):
    """Equal rows, doubles to nine digits."""
    plain = lambda r: tuple(f"{x:.9g}" if isinstance(x, float) else str(x) for x in r)
    return sorted(map(plain, a)) == sorted(map(plain, b))
