"""Small cases with values worked out by hand: name -> (function, SQL of the values)."""

CASES = {}


def query(sql=None):
    def add(f):
        CASES[f.__name__] = (f, sql)
        return f

    return add
