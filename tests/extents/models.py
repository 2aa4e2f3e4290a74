"""Small models that do one thing after another, to hold the plans against."""


def overlay(writes):
    """{offset: (write, log position)} after all writes in order."""
    held = {}
    for w in sorted(writes, key=lambda w: w["seq"]):
        for i in range(w["length"]):
            held[w["gfid"], w["file_pos"] + i] = (w, w["log_pos"] + i)
    return held


def maximal(held, same):
    """Runs of neighbours in file and log that agree on ``same``."""
    out = []
    for (gfid, at), (w, log) in sorted(held.items(), key=lambda x: x[0]):
        key = tuple(w[c] for c in same)
        if out and out[-1][0] == gfid and out[-1][2] + 1 == at and out[-1][3] + at - out[-1][1] == log and out[-1][4] == key:
            out[-1][2] = at
        else:
            out.append([gfid, at, at, log, key])
    return sorted(tuple(x) for x in out)
