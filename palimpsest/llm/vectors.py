"""Embedding near-duplicates by an inverted file with product quantisation."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut_lineage
from .components import connected_components

COSINE = 0.98
SAMPLE = 16_384  # vectors at most that the quantisers are fitted on
MOST_WIDTH = 2048  # components that the quantisers look at; the rest counts for exact cosines only
PER_LIST = 40  # vectors of the largest label in a list, about
CENTRES = 1024  # at most, on each of two levels
MARGIN = 4.0  # deviations of a partner's part along one direction that probes allow for
SUBSPACES = 8
CODES = 256
TILE_MEMBERS, TILE_QUERIES = 1024, 4096


def k_means(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 8) -> np.ndarray:
    centres = x[rng.choice(len(x), k, replace=False)]
    for _ in range(rounds):
        near = nearest(x, centres)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, x)
        n = np.bincount(near, minlength=k)[:, None]
        centres = np.where(n > 0, sums / np.maximum(n, 1), centres)
    return centres


def squares(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(1)[:, None] + (y * y).sum(1)[None] - 2 * x @ y.T, 0)


def nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.concatenate([squares(x[i : i + 2048], centres).argmin(1) for i in range(0, len(x), 2048)])


def within(d: np.ndarray, home: np.ndarray, centres: np.ndarray, reach: float) -> np.ndarray:
    """Which centres' lists may hold a vector within ``reach`` of each row, from the
    squared distances ``d`` to the centres: to be nearer another centre than
    ``home`` it must be across the plane between the two, so a list may if that
    plane is within ``reach``."""
    apart = np.sqrt(squares(centres[home], centres))
    return d - d[np.arange(len(d)), home][:, None] <= 2 * reach * apart + 1e-9


class Quantiser:
    """Centres of the inverted lists, and for each subspace the code words of the
    residuals. Fitted on a bounded sample of unit vectors. With more than CENTRES
    lists there are two levels: a list is a centre and a second one near the
    residual."""

    def __init__(self, sample: np.ndarray, lists: int, seed: int = 42):
        rng = np.random.default_rng(seed)
        first = max(1, min(lists, CENTRES, len(sample)))
        self.centres = k_means(sample, first, rng)
        residual = sample - self.centres[nearest(sample, self.centres)]
        second = max(1, min(-(-lists // first), CENTRES, len(sample)))
        self.inner = k_means(residual, second, rng) if second > 1 else np.zeros((1, sample.shape[1]))
        residual = residual - self.inner[nearest(residual, self.inner)]
        self.parts = np.array_split(np.arange(sample.shape[1]), min(SUBSPACES, sample.shape[1]))
        self.words = [k_means(residual[:, p], min(CODES, len(sample)), rng) for p in self.parts]
        # Directions over which the vectors spread, as the participation ratio.
        spread = (sample - sample.mean(0)).T @ (sample - sample.mean(0))
        self.directions = max(1.0, np.trace(spread) ** 2 / max((spread * spread).sum(), 1e-300))
        if not all(np.isfinite(x).all() for x in (self.centres, self.inner, *self.words)):
            raise ValueError("the sample holds vectors that are not finite")

    def encode(self, x: np.ndarray, reach: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, list]:
        """Of unit vectors: list, residual codes, distance from the coded point,
        and the lists to probe: its own, and those of a higher number that may hold
        a vector within ``reach``. One in a lower list probes in turn, so each pair
        meets once. Only the part of the way to a partner that is normal to the
        plane between two lists leads across it; ways point anywhere in the
        ``directions`` of the vectors, so MARGIN deviations of that part are
        allowed for, and never more than ``reach``."""
        reach = min(1.0, MARGIN / math.sqrt(self.directions)) * reach
        d = squares(x, self.centres)
        outer = d.argmin(1)
        probe = within(d, outer, self.centres, reach)
        home, found = np.zeros(len(x), np.int64), []
        rest = x - self.centres[outer]
        e = squares(rest, self.inner)
        home = outer * len(self.inner) + e.argmin(1)
        residual = rest - self.inner[e.argmin(1)]
        codes = np.stack([nearest(residual[:, p], w) for p, w in zip(self.parts, self.words, strict=True)], 1).astype(np.uint8)
        coded = np.concatenate([w[codes[:, m]] for m, w in enumerate(self.words)], 1)
        error = np.sqrt(((residual[:, np.concatenate(self.parts)] - coded) ** 2).sum(1))
        for i in range(len(x)):
            at = np.flatnonzero(probe[i])
            if len(self.inner) > 1:
                e = squares(x[i] - self.centres[at], self.inner)
                rows, inner = np.nonzero(within(e, e.argmin(1), self.inner, reach))
                at = at[rows] * len(self.inner) + inner
            found.append(at[at >= home[i]].tolist())
        return home, codes, error, found

    def estimates(self, queries: np.ndarray, at: int, codes: np.ndarray) -> np.ndarray:
        """Asymmetric distances: each query's table of squared distances to the
        code words of a subspace is looked up by the members' codes."""
        residual = queries - self.centres[at // len(self.inner)] - self.inner[at % len(self.inner)]
        total = np.zeros((len(queries), len(codes)))
        for m, (part, words) in enumerate(zip(self.parts, self.words, strict=True)):
            total += squares(residual[:, part], words)[:, codes[:, m]]
        return np.sqrt(total)


def roots_of(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes of the edges ``a, b`` and the least node of each one's component."""
    nodes, flat = np.unique(np.concatenate([a, b]), return_inverse=True)
    i, j = flat[: len(a)], flat[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        np.minimum.at(new, label[i], low)
        np.minimum.at(new, label[j], low)
        new = new[new]
        if (new == label).all():
            return nodes, nodes[label]
        label = new


def near_vectors(table: DataFrame, cosine: float = COSINE) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` of every row of
    ``table(vec_id, embedding, label)``; rows link if their labels are equal and
    their cosine, in double precision, is at least ``cosine``.

    Rows of one label and vector are one node with a count, by partial
    aggregation, so copies cost nothing. Nodes are listed under their coarse
    centre and probe each list that may hold a partner, with a chance of about
    6e-5 at MARGIN to miss one that is just within reach and behind a plane, and
    none below 17 directions; candidates are those whose asymmetric distance is
    within reach after allowing for the member's own coding error, which loses
    none, and each candidate's exact cosine decides. The number of lists grows
    with the largest label, up to CENTRES squared, and the lists that a vector
    probes hardly grow. A list that is large is
    worked on in tiles of bounded size; a tile returns link counts and a spanning
    forest, never its pairs. The quantisers are fitted on at most SAMPLE vectors,
    chosen by hash, and on their first MOST_WIDTH components, which are never
    farther apart than the whole vectors; every row is indexed.

    Defined results: rows whose label is null, or whose vector is null, empty or
    zero or has null or non-finite components, link with nothing; vectors of
    different length are not compared; very large and very small components are
    scaled by a power of two first; a null vec_id counts as a link of others
    but names no component unless all do, and repeated rows count each; extra
    columns are not read; an empty table gives no rows.
    """
    spark = table.sparkSession
    table = table.select("vec_id", "label", F.col("embedding").alias("v"))
    number = lambda x: x.cast("double")
    sound = F.col("label").isNotNull() & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(number(x)) & (F.abs(number(x)) < float("inf"))) & F.exists("v", lambda x: x != 0)
    marked = table.withColumn("sound", F.coalesce(sound, F.lit(False)))
    for seed in range(64):  # until no two nodes share a number
        node = F.when(F.col("sound"), F.xxhash64(F.lit(seed), "label", "v"))
        rows = cut_lineage(marked.select("vec_id", "label", "v", node.alias("node")))
        nodes = rows.where("node is not null").groupBy("label", "v").agg(F.count("*").alias("n"), F.min("vec_id").alias("least"), F.first("node").alias("node"))
        nodes = cut_lineage(nodes)
        facts = nodes.agg(F.count("*").alias("n"), F.count_distinct("node").alias("numbers"), F.max(F.size("v")).alias("dim")).first()
        if facts["n"] == facts["numbers"]:
            break
    if not facts["n"]:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    n, dim = facts["n"], min(facts["dim"], MOST_WIDTH)
    largest = nodes.groupBy("label").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0]
    share = min(1.0, SAMPLE / n)
    sample = nodes.where(F.pmod(F.xxhash64("node"), F.lit(1_000_003)) <= int(share * 1_000_003)).select(F.slice("v", 1, dim).alias("v")).limit(SAMPLE)
    fit = cut([r["v"] for r in sample.collect()] or [np.ones(dim)], dim)
    quantiser = spark.sparkContext.broadcast(Quantiser(fit, max(1, largest // PER_LIST)))
    reach = math.sqrt(max(0.0, 2 - 2 * cosine)) + 1e-9

    def index(batches):
        for pdf in batches:
            for i in range(0, len(pdf), 1024):
                part = pdf.iloc[i : i + 1024]
                home, codes, error, probes = quantiser.value.encode(cut(part["v"], dim), reach)
                yield pd.DataFrame({
                    "label": part["label"], "width": [len(v) for v in part["v"]], "node": part["node"], "n": part["n"], "v": part["v"],
                    "home": home, "codes": [c.tobytes() for c in codes], "error": error, "probes": probes,
                })

    kind = {c: table.schema[c].dataType.simpleString() for c in ("label", "v")}
    coded = cut_lineage(
        nodes.select("label", "v", "n", "node").mapInPandas(
            index, f"label {kind['label']}, width int, node long, n long, v {kind['v']}, home int, codes binary, error double, probes array<int>"
        )
    )
    key = ["label", "width", "list"]
    members = coded.withColumn("list", F.col("home"))
    queries = coded.withColumn("list", F.explode("probes"))
    sizes = members.groupBy(*key).agg(F.count("*").alias("m")).join(queries.groupBy(*key).agg(F.count("*").alias("q")), key)
    sizes = cut_lineage(sizes.select(*key, F.ceil(F.col("m") / TILE_MEMBERS).cast("int").alias("mt"), F.ceil(F.col("q") / TILE_QUERIES).cast("int").alias("qt")))
    mine = lambda tiles: F.pmod(F.xxhash64("node"), F.col(tiles)).cast("int")
    every = lambda tiles: F.explode(F.sequence(F.lit(0), F.col(tiles) - 1))
    none = lambda c, type_: F.lit(None).cast(type_).alias(c)
    member_rows = members.join(sizes, key).select(*key, mine("mt").alias("mi"), every("qt").alias("qi"), "node", "n", "v", none("home", "int"), "codes", "error")
    query_rows = queries.join(sizes, key).select(*key, every("mt").alias("mi"), mine("qt").alias("qi"), "node", "n", "v", "home", none("codes", "binary"), none("error", "double"))

    def tile(pdf: pd.DataFrame) -> pd.DataFrame:
        is_member = pdf["error"].notna().to_numpy()
        ms, qs = pdf[is_member], pdf[~is_member]
        empty = pd.DataFrame({"node": np.zeros(0, np.int64), "links": np.zeros(0, np.int64), "root": np.zeros(0, np.int64)})
        if not len(ms) or not len(qs):
            return empty
        at = int(pdf["list"].iloc[0])
        raw_m, raw_q = scaled(ms["v"]), scaled(qs["v"])
        codes = np.stack([np.frombuffer(c, np.uint8) for c in ms["codes"]])
        norm_m, norm_q = np.sqrt((raw_m * raw_m).sum(1)), np.sqrt((raw_q * raw_q).sum(1))
        ids_m, ids_q, n_m, n_q = ms["node"].to_numpy(), qs["node"].to_numpy(), ms["n"].to_numpy(), qs["n"].to_numpy()
        across = qs["home"].to_numpy() != at  # such a pair meets here only, one of the list itself both ways
        found_q, found_m = [], []
        for i in range(0, len(qs), 512):
            near = quantiser.value.estimates(cut(raw_q[i : i + 512], dim), at, codes)
            a, b = np.nonzero(near <= reach + ms["error"].to_numpy()[None] + 1e-6)
            for s in range(0, len(a), 100_000):
                x, y = a[s : s + 100_000] + i, b[s : s + 100_000]
                exact = np.einsum("ij,ij->i", raw_q[x], raw_m[y]) / (norm_q[x] * norm_m[y])
                good = (exact >= cosine) & (ids_q[x] != ids_m[y])
                found_q.append(x[good])
                found_m.append(y[good])
        q, m = np.concatenate([*found_q, []]).astype(int), np.concatenate([*found_m, []]).astype(int)
        if not len(q):
            return empty
        by_q = np.bincount(q, weights=n_m[m], minlength=len(qs)).astype(np.int64)
        by_m = np.bincount(m, weights=n_q[q] * across[q], minlength=len(ms)).astype(np.int64)
        node, root = roots_of(ids_q[q], ids_m[m])
        made = [(ids_q[by_q > 0], by_q[by_q > 0]), (ids_m[by_m > 0], by_m[by_m > 0])]
        made = [pd.DataFrame({"node": ids, "links": links, "root": ids}) for ids, links in made]
        return pd.concat([*made, pd.DataFrame({"node": node, "links": np.int64(0), "root": root})])

    tiles = member_rows.unionByName(query_rows).groupBy(*key, "mi", "qi").applyInPandas(tile, "node long, links long, root long")
    tiles = cut_lineage(tiles)
    links = tiles.groupBy("node").agg(F.sum("links").alias("links"))
    roots = connected_components(tiles.select(F.col("node").alias("a"), F.col("root").alias("b")))
    named = nodes.select("node", "n", "least").join(roots, "node", "left").join(links, "node", "left")
    named = cut_lineage(named.withColumn("root", F.coalesce("root", "node")))
    # Written, so that a root that very many share is a plain join that Spark can split.
    least = cut_lineage(named.groupBy("root").agg(F.min("least").alias("component_id")))
    named = named.join(least, "root").select("node", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), "component_id")
    out = rows.select("vec_id", "node").join(named, "node", "left")
    component = F.when(F.col("node").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def scaled(vectors) -> np.ndarray:
    """Vectors of one length as rows of doubles, each times a power of two that
    brings its largest component near 1: exact, and squares neither overflow nor
    vanish."""
    x = np.array(list(vectors), np.float64)
    return np.ldexp(x, -np.frexp(np.abs(x).max(1))[1][:, None])


def cut(vectors, width: int) -> np.ndarray:
    """The first ``width`` components of vectors of any length, divided by the whole
    vector's norm; zeros where there are fewer, and for a vector of zeros."""
    out = np.zeros((len(vectors), width))
    lengths = np.array([len(v) for v in vectors])
    vectors = list(vectors)
    for n in np.unique(lengths):
        rows = np.flatnonzero(lengths == n)
        x = scaled([vectors[i] for i in rows])
        norms = np.sqrt((x * x).sum(1))
        out[rows, : min(n, width)] = (x / np.where(norms > 0, norms, 1)[:, None])[:, :width]
    return out
