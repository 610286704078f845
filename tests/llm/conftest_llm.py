def by_row(frame):
    return sorted(repr(tuple(r)) for r in frame.collect())
