"""Small graphs for tests."""

from lattix.schema import ENTITY, REL


def entities(spark, *rows):
    """(id, kind[, name[, properties[, pkg[, registry]]]])"""
    full = []
    for r in rows:
        id_, kind, name, props, pkg, reg = (*r, *[None] * 6)[:6]
        full.append((id_, name or id_, kind, props or "{}", pkg or "", reg or "", "t", "http://t", "2024-01-01"))
    return spark.createDataFrame(full, ENTITY)


def relations(spark, *rows):
    """(from, kind, to[, properties])"""
    return spark.createDataFrame([(r[0], r[2], r[1], r[3] if len(r) > 3 else "{}", "t", "http://t", "2024-01-01") for r in rows], REL)
