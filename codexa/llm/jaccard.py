"""N-gram Jaccard join with multiple-global-order filtering: exact links, reported as components.

1. Every text becomes a set of shingle hashes; texts of equal sets form one class, which stands for all its copies.
2. Under any global order of the tokens, two sets that link share a token among the first ``n - need(n) + 1``
   (their prefix). Three orders are used: rarest first (by counts over all documents), rarest first in coarse steps with
   other ties, and a random order. Postings of the first order's prefixes find the candidates. A candidate pair must pass
   the length and place bounds, must not differ in too many parity bits (a lower bound of the sets' difference), and must
   share a prefix token under the other two orders as well, before the sets are sent anywhere and compared.
3. Each class is compared with the ``HEADS`` leaders that most of its lists have; links join classes into components, and lists of
   one component are closed. A list is led by the class that has the fewest tokens before the list's own: what a copy changed
   is rare and stands before what it shares, so this is the middle of a group of near copies, which links with more of them
   than a class taken at random (two copies differ by the changes of both). The pairs of *different* components in the
   lists left are all filtered, and compared if the filters leave them open, so no link between different texts is lost
   that could change a component. Only where those lists hold too many pairs for that (``WHOLE``, ``EACH``) do classes of
   the long ones first meet ``FEW`` leaders of other components in rounds, for as long as this finds more than single
   links; rounds cost many small stages.
4. Up to ``LOCAL`` links are joined into components on the driver, and the labels are broadcast; more by rounds of joins.

Token counts come from a table of fixed width over hashed tokens, added up over all documents: any count works, as it
only sets the order, and the number of parts that a frequent token's list is dealt into. Sets hold 56 bits of each
token's hash; classes are named by 64 bits.

Edge cases: null, empty and wordless texts have an empty set and link with nothing; texts shorter than k words have one
shingle, the whole sequence; repeated rows and exact copies fall into one class; a null id is never a component's name
unless no id is known; columns of other names are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from functools import reduce
from operator import add

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codexa.llm.common import delete, gather, map_texts, materialise, pieces, private, table, tidy
from codexa.llm.graph import connected_components
from codexa.llm.words import mix, scan, shingles

WIDTH, PIECE, BYTES, SIGNS, SALTS, NAMED, FEW, HEADS = 1 << 20, 1 << 14, 7, 8, 16, 24, 8, 4
#: Pairs in lists that are all filtered without leader rounds: so many in all, or for each posting. Links held on the driver.
WHOLE, EACH, LOCAL = 1 << 26, 256, 1 << 19
_MASK = np.uint64((1 << 8 * BYTES) - 1)
_SIGNS = [f"s{k}" for k in range(SIGNS)]


def pack(tokens: np.ndarray) -> bytes:
    """Sorted tokens, the lowest ``BYTES`` bytes of each."""
    return tokens.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :BYTES].tobytes()


def unpack(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // BYTES, 8), np.uint8)
    out[:, :BYTES] = np.frombuffer(data, np.uint8).reshape(-1, BYTES)
    return out.view("<u8").ravel()


def parity(tokens: np.ndarray) -> np.ndarray:
    """Bytes of a power of two of bits, two for each token at least: each tells whether an odd number of tokens hash to it.

    Tokens of both sets cancel out, so two sets differ in at least as many tokens as their numbers in bits.
    """
    bits = max(64 * SIGNS, 1 << (2 * len(tokens) - 1).bit_length())
    place = (mix(tokens, 21) & np.uint64(bits - 1)).astype(np.int64)
    return np.packbits((np.bincount(place, minlength=bits) & 1).astype(np.uint8))


def folded(bits: np.ndarray, size: int) -> np.ndarray:
    """The parity bits as ``size`` bytes would have them."""
    return np.bitwise_xor.reduce(bits.reshape(-1, size), axis=0)


def sets(docs: DataFrame, k: int) -> DataFrame:
    """(doc_id, text) -> doc_id, n, class, tokens, s0...: the shingle set of every whole text and a hash of the set.

    The tokens of copies that one task meets are held once.
    """

    def make():
        seen: set[int] = set()

        def each(texts):
            w = scan(texts)
            h, first = shingles(w.hashes(), w.first, k)
            h &= _MASK
            found = [np.unique(h[a:b]) for a, b in zip(first[:-1], first[1:], strict=True)]
            whole = np.concatenate([*found, np.zeros(0, np.uint64)])
            n = np.array([len(x) for x in found], np.int64)
            at = np.r_[0, np.cumsum(n)]
            sums = np.r_[np.uint64(0), np.cumsum(mix(whole, 3))]
            name = mix(sums[at[1:]] - sums[at[:-1]] + n.astype(np.uint64), 5).astype(np.int64)
            fresh = []
            for x in name.tolist():
                fresh.append(x not in seen)
                seen.add(x)
            tokens = [pack(x) if new and len(x) else None for x, new in zip(found, fresh, strict=True)]
            narrow = np.array([folded(parity(x), 8 * SIGNS) for x in found], np.uint8).reshape(-1, 8 * SIGNS).view(np.int64)
            return [n, name, tokens, *narrow.T]

        return each

    return map_texts(docs.select("doc_id", "text"), ["doc_id"], make, "n long, class long, tokens binary, " + ", ".join(f"{s} long" for s in _SIGNS))


def token_counts(owned: DataFrame) -> np.ndarray:
    """How often tokens of each hash bucket occur in the sets of all documents (copies met by one task count once)."""

    def run(frames):
        total = np.zeros(WIDTH, np.int32)
        for frame in frames:
            held, size = [], 0
            for data in frame["tokens"]:
                held.append(unpack(data))
                size += len(held[-1])
                if size > 250_000:
                    total += np.bincount((np.concatenate(held) & np.uint64(WIDTH - 1)).astype(np.int64), minlength=WIDTH).astype(np.int32)
                    held, size = [], 0
            if held:
                total += np.bincount((np.concatenate(held) & np.uint64(WIDTH - 1)).astype(np.int64), minlength=WIDTH).astype(np.int32)
        yield pieces(total.astype(np.int64), PIECE)

    return gather(owned.where("tokens is not null").select("tokens").mapInPandas(run, "piece int, data binary"), WIDTH, PIECE)


def order_key(tokens: np.ndarray, counts: np.ndarray, order: int) -> np.ndarray:
    """Sort keys of one of the three global orders; the same token has the same key in every set."""
    tie = mix(tokens, 11 + order) >> np.uint64(20)
    if order == 2:
        return tie
    count = counts[(tokens & np.uint64(WIDTH - 1)).astype(np.int64)].astype(np.uint64)
    if order == 1:
        count = np.floor(np.log2(np.maximum(count, 1))).astype(np.uint64)
    return (np.minimum(count, np.uint64((1 << 20) - 1)) << np.uint64(44)) | tie


def prefix(tokens: np.ndarray, counts: np.ndarray, order: int, percent: int) -> np.ndarray:
    """The first tokens of the set under an order: enough that any linking set shares one of them."""
    n = len(tokens)
    length = n - -(-n * percent // 100) + 1
    return tokens[np.argsort(order_key(tokens, counts, order), kind="stable")[:length]]


def postings(owned: DataFrame, shared, percent: int) -> DataFrame:
    """(token, class, n, at): the first order's prefixes."""

    def run(frames):
        import pandas as pd

        counts = shared.value
        for frame in frames:
            for a in range(0, len(frame), 200):
                part = frame.iloc[a : a + 200]
                found = [prefix(unpack(data), counts, 0, percent) for data in part["tokens"]]
                lengths = [len(x) for x in found]
                yield pd.DataFrame(
                    {
                        "token": np.concatenate(found).astype(np.int64), "class": np.repeat(part["class"].to_numpy(), lengths),
                        "n": np.repeat(part["n"].to_numpy(np.int32), lengths), "at": np.concatenate([np.arange(x, dtype=np.int32) for x in lengths]),
                    }
                )

    return owned.where("tokens is not null").select("n", "class", "tokens").mapInPandas(run, "token long, class long, n int, at int")


def frequent(counts: np.ndarray) -> list[tuple[int, int]]:
    """(bucket, parts) of the buckets with many times the usual count, at most WIDTH / 64 of them: their lists are dealt into parts."""
    limit = max(20_000, 64 * int(counts.mean()))
    hot = np.flatnonzero(counts > limit)
    return [(int(b), min(int(counts[b] // limit) + 1, 1 << 12)) for b in hot]


def shared_lists(posted: DataFrame) -> DataFrame:
    """The postings whose token (and part) two classes have at least, each once; lists that are dealt into parts stay whole."""

    def run(frames):
        import pandas as pd

        held, sure = None, False  # the last row so far: whether it stays may depend on the next
        for frame in frames:
            if held is not None:
                frame = pd.concat([held, frame], ignore_index=True)
            token, part, name = (frame[c].to_numpy() for c in ("token", "part", "class"))
            same = np.r_[False, (token[1:] == token[:-1]) & (part[1:] == part[:-1])]
            keep = ~(same & np.r_[False, name[1:] == name[:-1]])
            frame, same = frame[keep], same[keep]
            stay = same | np.r_[same[1:], False] | (frame["parts"].to_numpy() > 1)
            stay[0] |= sure
            held, sure = frame.iloc[-1:], bool(stay[-1])
            yield frame.iloc[:-1][stay[:-1]]
        if held is not None and sure:
            yield held

    dealt = posted.repartition("token", "part").sortWithinPartitions("token", "part", "class")
    return dealt.mapInPandas(run, posted.schema)


def fits(n, m, at, bt, percent: int):
    """Whether sets of sizes n and m can link that share a token at places at and bt of the first order.

    For the first token that a pair shares, the tokens from there on bound the overlap; a pair that can link passes at
    that token, so it is enough to ask this of every shared token by itself.
    """
    overlap = F.least(n - at, m - bt)
    return (F.least(n, m) * 100 >= F.greatest(n, m) * percent) & (overlap * (100 + percent) >= (n + m) * percent)


def near(x: str, y: str, percent: int):
    """Whether the parity bits of two sets (columns of the prefixes ``x`` and ``y``) leave it open that they link."""
    n = F.col(f"{x}n") + F.col(f"{y}n")
    differ = reduce(add, [F.bit_count(F.col(f"{x}{s}").bitwiseXOR(F.col(f"{y}{s}"))) for s in _SIGNS])
    return (n - differ) * (100 + percent) >= n * (2 * percent)


def alike(percent: int):
    """Rows (a, b, n, m, x, y) -> the pairs (a, b) of sets of sizes n and m that all their parity bits x and y leave open."""

    def run(frames):
        for frame in frames:
            good = []
            for n, m, x, y in frame[["n", "m", "x", "y"]].itertuples(index=False, name=None):
                size = min(len(x), len(y))
                p, q = folded(np.frombuffer(x, np.uint8), size), folded(np.frombuffer(y, np.uint8), size)
                differ = int(np.bitwise_count(p ^ q).sum())
                good.append((n + m - differ) * (100 + percent) >= 2 * percent * (n + m))
            yield frame.loc[np.array(good, bool), ["a", "b"]]

    return run


def named(pairs: DataFrame) -> np.ndarray:
    """A filter of 2 ** NAMED bits of the classes in ``pairs``: its size is fixed, and it only saves reading other classes' sets.

    At most 16 tasks make one each, packed, so that nothing is shuffled for it.
    """

    def run(frames):
        import zlib

        import pandas as pd

        there = np.zeros(1 << NAMED, bool)
        for frame in frames:
            for c in frame.columns:
                there[frame[c].to_numpy()] = True
        yield pd.DataFrame({"bits": [zlib.compress(np.packbits(there, bitorder="little").tobytes(), 1)]})

    import zlib

    at = pairs.select(*(F.pmod(F.xxhash64(c), F.lit(1 << NAMED)).alias(c) for c in ("a", "b")))
    out = np.zeros(1 << (NAMED - 3), np.uint8)
    for row in at.coalesce(min(16, pairs.sparkSession.sparkContext.defaultParallelism)).mapInPandas(run, "bits binary").collect():  # at most 16 rows
        out |= np.frombuffer(zlib.decompress(row["bits"]), np.uint8)
    return out


def fetched(owned: DataFrame, pairs: DataFrame, make, shape: str):
    """(class, ...) of the classes in ``pairs``, each once: what ``make`` gives for packed sets; and the filter to unpersist.

    Dealt by class, so that joins by class don't deal it again.
    """
    bits = owned.sparkSession.sparkContext.broadcast(named(pairs))

    def run(frames):
        import pandas as pd

        for frame in frames:
            at = frame["at"].to_numpy()
            frame = frame[(bits.value[at >> 3] >> (at & 7)) & 1 == 1]
            for a in range(0, len(frame), 200):
                part = frame.iloc[a : a + 200]
                yield pd.DataFrame({"class": part["class"].tolist()} | make(part["tokens"].tolist()))

    rows = owned.where("tokens is not null").select("class", F.pmod(F.xxhash64("class"), F.lit(1 << NAMED)).alias("at"), "tokens")
    return rows.mapInPandas(run, f"class long, {shape}").dropDuplicates(["class"]), bits


def links(pairs: DataFrame, owned: DataFrame, shared, percent: int) -> DataFrame:
    """(a, b) of classes, each pair once -> a table of the pairs that link.

    Prefixes under the other two orders and all parity bits meet first; only the sets of pairs that share a token under
    both and that the bits leave open are sent and compared. Of classes outside the pairs nothing is sent.
    """
    spark = owned.sparkSession
    pairs = materialise(pairs, "jaccard-pairs")
    tidy(spark)

    def signs(data):
        tokens = [unpack(x) for x in data]
        p1, p2 = ([(prefix(x, shared.value, o, percent) >> np.uint64(24)).astype(np.uint32).view(np.int32) for x in tokens] for o in (1, 2))
        return {"n": [len(x) for x in tokens], "p1": p1, "p2": p2, "wide": [parity(x).tobytes() for x in tokens]}

    def run(frames):
        for frame in frames:
            good = np.zeros(len(frame), bool)
            last, y_set = None, None
            for i, (b, x, y) in enumerate(frame[["b", "x", "y"]].itertuples(index=False, name=None)):
                if b != last:
                    last, y_set = b, unpack(y)
                x_set = unpack(x)
                both = common(x_set, y_set)
                good[i] = 100 * both >= percent * (len(x_set) + len(y_set) - both)
            yield frame.loc[good, ["a", "b"]]

    def side(of, at, **columns):
        return of.select(F.col("class").alias(at), *(F.col(c).alias(name) for name, c in columns.items()))

    known, bits = fetched(owned, pairs, signs, "n long, p1 array<int>, p2 array<int>, wide binary")
    met = pairs.join(side(known, "a", x1="p1", x2="p2", n="n", x="wide"), "a").join(side(known, "b", y1="p1", y2="p2", m="n", y="wide"), "b")
    met = met.where(F.arrays_overlap("x1", "y1") & F.arrays_overlap("x2", "y2")).select("a", "b", "n", "m", "x", "y")
    left = materialise(met.mapInPandas(alike(percent), "a long, b long"), "jaccard-pairs")
    bits.unpersist()
    delete(spark, pairs)
    sets_, bits = fetched(owned, left, lambda data: {"tokens": data}, "tokens binary")
    met = left.join(side(sets_, "a", x="tokens"), "a").join(side(sets_, "b", y="tokens"), "b").select("a", "b", "x", "y")
    found = materialise(met.mapInPandas(run, "a long, b long"), "jaccard-links")
    bits.unpersist()
    delete(spark, left)
    return found


def common(a: np.ndarray, b: np.ndarray) -> int:
    """How many numbers two sorted sets share."""
    at = np.searchsorted(a, b)
    at[at == len(a)] = 0
    return int(np.count_nonzero(a[at] == b)) if len(a) else 0


def led(now: DataFrame, step: float, percent: int, hot: list[tuple[int, int]]) -> DataFrame:
    """(a, b): each class with the ``HEADS`` leaders that most of its lists have, where the two are of different components.

    The class whose prefix reaches the list's token first leads; ties by a hash.
    """
    rows = now.withColumn("band", F.floor(F.log("n") / F.lit(step)).cast("int"))
    first = F.min_by(F.struct("class", "n", "at", "comp"), F.struct("at", F.xxhash64("class")))
    met = rows.withColumn("head", first.over(Window.partitionBy("token", "part", "band"))).select("class", "n", "at", "comp", "head")
    if hot:  # the leaders of a dealt list's parts meet in their turn
        buckets = F.broadcast(now.sparkSession.createDataFrame(hot, "bucket int, parts int"))  # at most WIDTH / 64 rows
        parts = rows.join(buckets, F.col("token").bitwiseAND(F.lit(WIDTH - 1)) == F.col("bucket"), "left_semi").groupBy("token", "part", "band").agg(first.alias("head"))
        parts = parts.select("token", "band", "head.*")
        top = parts.groupBy("token", "band").agg(first.alias("head"), F.count(F.lit(1)).alias("c")).where("c > 1").drop("c")
        met = met.unionByName(parts.join(top, ["token", "band"]).select("class", "n", "at", "comp", "head"))
    met = met.where((F.col("comp") != F.col("head.comp")) & fits(F.col("n"), F.col("head.n"), F.col("at"), F.col("head.at"), percent))
    # dealt by class once, which serves both counts
    votes = met.select("class", F.col("head.class").alias("head")).repartition("class").groupBy("class", "head").agg(F.count(F.lit(1)).alias("votes"))
    # no more leaders than the class has lists
    most = votes.groupBy("class").agg(F.slice(F.sort_array(F.collect_list(F.struct("votes", "head")), asc=False), 1, HEADS).alias("most"))
    return most.select(F.col("class").alias("a"), F.explode("most.head").alias("b"))


def grouped(owned: DataFrame, shared, percent: int) -> tuple[DataFrame, int]:
    """(class, comp): the components that links join classes into; classes without links have no row. And the number of links."""
    spark = owned.sparkSession
    hot = frequent(shared.value)
    posted = postings(owned, shared, percent)
    if hot:
        parts = F.broadcast(spark.createDataFrame(hot, "bucket int, parts int"))  # at most WIDTH / 64 rows
        posted = posted.join(parts, F.col("token").bitwiseAND(F.lit(WIDTH - 1)) == F.col("bucket"), "left").withColumn("parts", F.coalesce("parts", F.lit(1))).drop("bucket")
    else:
        posted = posted.withColumn("parts", F.lit(1))
    posted = posted.withColumn("part", F.pmod(F.xxhash64("class"), F.col("parts")).cast("int"))
    now = materialise(shared_lists(posted).drop("parts").withColumn("comp", F.col("class")), "jaccard-lists")
    del posted
    tidy(spark)
    signs = materialise(owned.where("tokens is not null").select("class", "n", *_SIGNS).dropDuplicates(["class"]), "jaccard-signs")
    side = lambda at, p: signs.select(F.col("class").alias(at), *(F.col(c).alias(p + c) for c in ("n", *_SIGNS)))

    step = float(np.log(100 / percent))
    # each class and a few leaders of its lists
    pairs = led(now, step, percent, hot).join(side("a", "x"), "a").join(side("b", "y"), "b").where(near("x", "y", percent))
    found = [links(pairs.select("a", "b"), owned, shared, percent)]
    some = found[0].count()
    labels = labelled(found, None, some)
    sized = still_open(now.drop("part"), hinted(labels, some), signs)
    delete(spark, now)
    now = sized
    turn, few = 0, None
    # where all pairs of the lists would be too many: FEW leaders each in the long lists, as long as that finds more than single links
    while crowded(now):
        if not turn:  # lists of a few classes: all their pairs, once
            few, now = apart(sized.where(F.col("c") <= FEW), percent), sized.where(F.col("c") > FEW)
        pairs = met(now, step, turn, percent)
        pairs = pairs if turn else pairs.unionByName(few)
        found.append(links(pairs.distinct(), owned, shared, percent))
        new = found[-1].count()
        some += new
        labels = labelled(found, labels, some)
        after = still_open(now.drop("c", *_SIGNS), hinted(labels, some), signs)
        delete(spark, now if turn else sized)
        now, turn = after, turn + 1
        if new <= some // 100:
            break
    # the pairs of different components in one list, at the tokens that leave it open whether they link
    found.append(links(apart(now, percent).distinct(), owned, shared, percent))
    some += found[-1].count()
    tidy(spark)
    if some <= LOCAL:
        comps = labelled(found, None, some)
    else:
        comps = connected_components(reduce(DataFrame.unionByName, found).select(F.col("a").alias("src"), F.col("b").alias("dst")))
        comps = materialise(comps.select(F.col("node").alias("class"), F.col("component").alias("comp")), "jaccard-comps")
    for done in (now, signs, labels, *found):
        delete(spark, done)
    return comps, some


def still_open(now: DataFrame, labels: DataFrame, signs: DataFrame) -> DataFrame:
    """The lists with the components as ``labels`` know them, their lengths and signs; those of one component are closed."""
    after = now.drop("comp").join(labels, "class", "left").withColumn("comp", F.coalesce("comp", "class")).select(now.columns)
    several = after.groupBy("token").agg(F.min("comp").alias("low"), F.max("comp").alias("high"), F.count(F.lit(1)).alias("c")).where("low < high")
    return materialise(after.join(several.select("token", "c"), "token").join(signs.drop("n"), "class"), "jaccard-lists")


def crowded(now: DataFrame) -> bool:
    """Whether the lists hold too many pairs to filter them all."""
    row = now.agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("c") - 1).alias("twice")).first()
    return (row["twice"] or 0) // 2 > WHOLE + EACH * row["n"]


def hinted(labels: DataFrame, some: int) -> DataFrame:
    """Labels of up to ``LOCAL`` links are broadcast."""
    return F.broadcast(labels) if some <= LOCAL else labels


def labelled(found: list[DataFrame], before: DataFrame | None, some: int) -> DataFrame:
    """(class, comp) for the classes of all ``some`` links so far: whole components if the driver can hold them, else :func:`spread`."""
    links_ = reduce(DataFrame.unionByName, found)
    if some > LOCAL:
        return spread(links_, before)
    import pyarrow as pa

    spark = links_.sparkSession
    held = links_.select("a", "b").toArrow()  # at most LOCAL rows
    names, comps = joined(held["a"].to_numpy(), held["b"].to_numpy())
    rows = spark.createDataFrame(pa.table({"class": names, "comp": comps})) if len(names) else spark.createDataFrame([], "class long, comp long")
    labels = materialise(rows.coalesce(1), "jaccard-labels")
    if before is not None:
        delete(spark, before)
    return labels


def joined(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of the edges (a, b), and the least node of each one's component."""
    nodes, at = np.unique(np.concatenate([a, b]).astype(np.int64), return_inverse=True)
    label, src, dst = np.arange(len(nodes)), at[: len(a)], at[len(a) :]
    while (label[src] != label[dst]).any():
        x, y = label[src], label[dst]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while (label != label[label]).any():
            label = label[label]
    return nodes, nodes[label]


def apart(rows: DataFrame, percent: int) -> DataFrame:
    """(a, b): pairs of different components that share a token and may link."""
    x, y = (rows.select(*(F.col(c).alias(p + c) for c in rows.columns)) for p in "xy")
    other = (F.col("xtoken") == F.col("ytoken")) & (F.col("xclass") < F.col("yclass")) & (F.col("xcomp") != F.col("ycomp"))
    able = fits(F.col("xn"), F.col("yn"), F.col("xat"), F.col("yat"), percent) & near("x", "y", percent)
    return x.join(y, other & able).select(F.col("xclass").alias("a"), F.col("yclass").alias("b"))


def met(now: DataFrame, step: float, turn: int, percent: int) -> DataFrame:
    """(a, b): classes and the leaders, FEW at most, of their lists that they may link with, in other components."""
    rows = now.withColumn("band", F.floor(F.log("n") / F.lit(step)))
    of = F.struct("class", "n", "at", "comp", *_SIGNS)
    lead = rows.groupBy("token", "band", F.pmod(F.xxhash64(F.col("class"), F.lit(turn)), F.lit(FEW)).alias("r")).agg(F.min_by(of, F.xxhash64(F.col("class"), F.lit(-1 - turn))).alias("head"))
    y = lead.select(F.col("token").alias("ytoken"), F.col("band").alias("yband"), *(F.col(f"head.{c}").alias(f"y{c}") for c in ("class", "n", "at", "comp", *_SIGNS)))
    x = rows.select(*(F.col(c).alias(f"x{c}") for c in rows.columns))
    other = (F.col("xtoken") == F.col("ytoken")) & (F.col("xband") == F.col("yband")) & (F.col("xcomp") != F.col("ycomp"))
    able = fits(F.col("xn"), F.col("yn"), F.col("xat"), F.col("yat"), percent) & near("x", "y", percent)
    return x.join(y, other & able).select(F.least("xclass", "yclass").alias("a"), F.greatest("xclass", "yclass").alias("b"))


def spread(found: DataFrame, labels: DataFrame | None) -> DataFrame:
    """(class, comp) for the classes of all links so far: the least class two links away at most from its earlier label.

    Every follower of a leader gets the same label; longer chains only partly do, which costs comparisons but loses no link.
    """
    both = found.unionByName(found.select(F.col("b").alias("a"), F.col("a").alias("b")))
    before = labels
    for _ in range(2):
        if labels is None:
            labels = both.groupBy(F.col("a").alias("class")).agg(F.least(F.min("b"), F.col("a")).alias("comp"))
        else:
            by_other = labels.select(F.col("class").alias("b"), F.col("comp").alias("other"))
            step = both.join(by_other, "b", "left").select(F.col("a").alias("class"), F.coalesce("other", "b").alias("comp"))
            labels = step.unionByName(labels).groupBy("class").agg(F.least(F.min("comp"), F.col("class")).alias("comp"))
    labels = materialise(labels, "jaccard-labels")
    if before is not None:
        delete(found.sparkSession, before)
    return labels


def components(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, text) -> doc_id, n_shingles, component_id (the smallest id that links lead to)."""
    spark = docs.sparkSession
    owned = materialise(sets(docs, k), "jaccard-owned")
    shared = spark.sparkContext.broadcast(token_counts(owned))  # WIDTH counts, whatever the input
    comps, some = grouped(owned, shared, percent)
    rows = owned.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("class")).alias("class"))
    names = rows.where("class is not null").groupBy("class").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("copies"))
    names = names.join(hinted(comps, some), "class", "left").withColumn("linked", F.col("comp").isNotNull()).withColumn("comp", F.coalesce("comp", "class"))
    lowest = names.groupBy("comp").agg(F.min("least").alias("component_id"))
    # only classes of several documents or with links need their name brought to them; it is, to each of SALTS parts of a class
    known = names.where("linked or copies > 1").join(lowest, "comp").select("class", "component_id", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    out = rows.withColumn("salt", F.pmod(F.xxhash64("doc_id", "n_shingles"), F.lit(SALTS)).cast("int")).join(known, ["class", "salt"], "left")
    out = materialise(out.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id")), "jaccard-out")
    shared.unpersist()
    delete(spark, owned)
    delete(spark, comps)
    return out


def one_of_each(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """All columns of the documents that stay: of each component the one of least id (a null id comes last; ties: by a hash).

    Rows that are equal in every column are one document. Documents without words stay.
    """
    row = private(docs, "row")
    keyed = docs.withColumn(row, F.xxhash64(*docs.columns))
    names = materialise(keyed.select(F.col(row).alias("row"), "doc_id").distinct(), "jaccard-names")
    found = components(keyed.select(F.col(row).alias("doc_id"), "text"), k, percent).distinct()
    joined = found.join(names.select("row", F.col("doc_id").alias("name")), F.col("doc_id") == F.col("row"))
    stay = joined.groupBy("component_id").agg(F.min_by("row", F.struct(F.col("name").isNull(), "name", "row")).alias(row)).select(row)
    return keyed.join(stay, row, "left_semi").dropDuplicates([row]).select(docs.columns)


def query(spark, sf_dir):
    """op4: components of all documents on 4-word shingles at 0.85."""
    return components(table(spark, sf_dir, "documents"), k=4, percent=85)


ORACLE = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 4 THEN [array_to_string(words, ' ')]
         ELSE list_distinct([array_to_string(words[i:i + 3], ' ') FOR i IN range(1, len(words) - 2)]) END AS shingles
  FROM w
), n AS (SELECT doc_id, len(shingles)::BIGINT AS n FROM s),
t AS (SELECT doc_id, hash(unnest(shingles)) AS token FROM s),
pairs AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM t a JOIN t b ON a.token = b.token AND a.doc_id < b.doc_id GROUP BY ALL
), links AS (
  SELECT a, b FROM pairs JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * common >= 85 * (x.n + y.n - common)
), sides AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach(a, b) AS (SELECT a, a FROM sides UNION SELECT r.a, e.b FROM reach r JOIN sides e ON r.b = e.a)
SELECT n.doc_id, n.n AS n_shingles, coalesce(least(min(r.b), n.doc_id), n.doc_id) AS component_id
FROM n LEFT JOIN reach r ON r.a = n.doc_id GROUP BY n.doc_id, n.n
"""
