"""Registry of the text queries: Spark callable and, where SQL can say it, the reference SQL."""

QUERIES: dict = {}
ORACLES: dict = {}


def query(name, sql=None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add
