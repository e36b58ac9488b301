"""Linking the spellings of one sender.

Every distinct spelling is cut into folded tokens; forms of address go, legal
forms get one spelling. Tokens one edit apart are found over a symmetric-delete
index and a rare token takes the spelling of its frequent neighbour. Spellings
left with the same tokens are one signature. Signatures that share a token of four
letters or more are aligned by optimal assignment, which permits initials, nicknames, words cut
short, acronyms and left-out generic words; a signature that fits two others that
do not fit each other stays alone. Links are closed to classes by propagating the
least signature.

The order in which the words of a signature were written is kept beside it, for
acronyms are read off the words as they stand.

Blocks hold all the signatures (not rows, not spellings) that share a token, however
common. Within a block only signatures that have a reading of another token in
common are aligned: the token, what one deletion leaves of it, its beginning, its
initial, its full name, or the initials of all the others (``readings``). Whatever
can be aligned shares one, so none is lost. A block of up to ``BLOCK`` signatures is
paired in one task, a larger one by exchange of the readings, with the same result.

Defined cases: null, empty and blank names have no class; repeated names are one
spelling; a name of signs only is its own class; extra columns are ignored; an
empty table gives no pairs.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import combinations, product

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .symdelete import deletes, edits, fold, shortens, squeezed

#: Signatures of a block paired in one task at most; it changes no result.
BLOCK = 2_000
#: Cost up to which a fit is sure and ambiguity does not matter.
SURE = 0.11

#: Forms of address, legal forms and joining words. Fixed values.
ADDRESS = frozenset("mr mrs ms miss dr prof herr fru frau hr froken mme madame mlle monsieur senor senora dhr mevr".split())
LEGAL = {
    "ltd": "ltd", "limited": "ltd", "plc": "plc", "inc": "inc", "llc": "llc", "llp": "llp", "ab": "ab", "aktiebolag": "ab",
    "aktiebolaget": "ab", "gmbh": "gmbh", "ag": "ag", "kg": "kg", "aps": "aps", "anpartsselskab": "aps", "aktieselskab": "as",
    "sarl": "sarl", "sas": "sas", "bv": "bv", "nv": "nv", "oy": "oy", "kb": "kb", "hb": "hb",
}
JOINING = frozenset("and och og und et of the for de des du la le den det van von der".split())
#: Short names and the full names they stand for. Fixed values.
NICKNAMES = {
    "alex": "alexander alexandra", "tony": "anthony antony", "gittan": "birgitta", "tina": "christina kristina martina", "chris": "christina christopher christian",
    "stina": "christina kristina", "dan": "daniel", "danny": "daniel", "ed": "edward", "eddie": "edward", "ted": "edward theodore", "ned": "edward",
    "liz": "elizabeth elisabeth", "beth": "elizabeth elisabeth", "betty": "elizabeth elisabeth", "lisa": "elisabeth elizabeth", "lisbeth": "elisabeth",
    "bettan": "elisabeth", "figge": "fredrik", "fredde": "fredrik", "fred": "frederick fredrik", "freddy": "fredrik frederick", "goran": "goran", "helen": "helene",
    "lena": "helene helena", "nacho": "inigo ignacio", "inga": "ingrid", "jojje": "george", "hasse": "johannes hans", "hans": "johannes", "johan": "johannes",
    "jorgen": "jorg", "kalle": "karl", "charlie": "karl charles", "kate": "katherine catherine", "kathy": "katherine", "katie": "katherine", "kit": "katherine",
    "lasse": "lars", "greta": "margareta", "maggan": "margareta", "maggie": "margaret margareta", "meg": "margaret", "mike": "michael", "mick": "michael",
    "micke": "michael mikael", "nisse": "nils", "olle": "olof olov", "pat": "patricia patrick", "trish": "patricia", "tricia": "patricia", "patty": "patricia",
    "nille": "pernille", "becky": "rebecca", "becca": "rebecca", "bob": "robert", "rob": "robert", "bobby": "robert", "bert": "robert albert", "sam": "samuel samantha",
    "sammy": "samuel", "ulla": "ulrika", "ulli": "ulrika", "vicky": "victoria", "vickan": "victoria", "tori": "victoria", "walt": "walter", "wally": "walter",
    "bill": "william", "will": "william", "billy": "william", "wille": "william", "liam": "william", "jim": "james", "jimmy": "james", "jack": "john", "johnny": "john",
    "dick": "richard", "rick": "richard", "peggy": "margaret", "jenny": "jennifer", "steve": "steven stephen", "tom": "thomas", "tim": "timothy", "kim": "joakim kimberly",
    "jocke": "joakim", "pelle": "per peter", "perra": "per", "janne": "jan", "affe": "alfred", "sven": "svante", "bosse": "bo", "nettan": "anette", "annika": "anna",
    "anki": "annkatrin", "putte": "per", "sussie": "susanne", "maja": "maria", "mia": "maria", "sanna": "susanna", "pia": "maria", "seppo": "josef", "sepp": "josef",
}
_DOTTED = re.compile(r"\b(?:\w\.){2,}")
_TOKEN = re.compile(r"\w+")


@lru_cache(maxsize=1)
def _nicknames() -> dict[str, frozenset[str]]:
    return {k: frozenset(v.split()) for k, v in NICKNAMES.items()}


def _plain(text: str) -> str:
    text = fold(unicodedata.normalize("NFKC", text))
    return text.replace("ø", "o").replace("æ", "ae").replace("ß", "ss").replace("đ", "d").replace("ł", "l")


def parts(name: str) -> tuple[list[str], str]:
    """Content tokens in order, and the legal form ('' if none)."""
    text = _DOTTED.sub(lambda m: m[0].replace(".", "") + " ", _plain(name).replace("&", " and ").replace("+", " and ").replace("'", ""))
    tokens = [t for t in _TOKEN.findall(text.replace("_", " "))]
    legal = ""
    content = []
    for t in tokens:
        if t in LEGAL and len(tokens) > 1:
            legal = legal or LEGAL[t]
        elif t not in ADDRESS and t not in JOINING:
            content.append(t)
    return content or tokens, legal


def token_cost(a: str, b: str) -> float | None:
    """What it costs to read token ``a`` as token ``b``, or None."""
    if a == b:
        return 0.0
    if len(a) > len(b):
        a, b = b, a
    if len(a) == 1:
        return 0.4 if b[0] == a else None
    nick = _nicknames()
    if b in nick.get(a, ()) or a in nick.get(b, ()):
        return 0.3
    if len(b) - len(a) <= 1 and edits(a, b) <= 1 and (len(a) >= 4 or len(a) == 3 and a[0] == b[0]):
        return 0.5
    if len(a) >= 5 and b.startswith(a) and len(b) - len(a) <= 2:
        return 0.4
    return 0.45 if shortens(a, b) else None


def assign(a: list[str], b: list[str]) -> tuple[float, int, list[int]] | None:
    """Cheapest way to read every token of ``a`` as a different token of ``b``.

    Returns the cost, how many tokens are equal and which of ``b`` are used. The
    search keeps, for each set of used tokens, the cheapest way only.
    """
    best: dict[int, tuple[float, int]] = {0: (0.0, 0)}
    for x in a:
        step: dict[int, tuple[float, int]] = {}
        for used, (cost, equal) in best.items():
            for j, y in enumerate(b):
                if used >> j & 1:
                    continue
                c = token_cost(x, y)
                if c is None:
                    continue
                now = (cost + c, equal - (c == 0.0))
                if (u := used | 1 << j) not in step or now < step[u]:
                    step[u] = now
        best = step
        if not best:
            return None
    used, (cost, equal) = min(best.items(), key=lambda x: (x[1], x[0]))
    return cost, -equal, [j for j in range(len(b)) if used >> j & 1]


#: Orders of the words of one signature, as they were written.
Orders = Iterable[tuple[str, ...]]


def _initials(tokens: Iterable[str]) -> str:
    return "".join(t[0] for t in tokens)


def _is_acronym(short: str, words: list[str], orders: Orders) -> bool:
    """Is ``short`` made of the initials of ``words`` in an order they were written in?"""
    if not 2 <= len(short) <= 4 or len(short) != len(words):
        return False
    return any(_initials(t for t in order if t in words) == short for order in orders or (tuple(words),))


def fits(a: list[str], b: list[str], orders_a: Orders = (), orders_b: Orders = ()) -> float | None:
    """Cost of ``a`` and ``b`` naming the same sender, or None.

    The shorter must be readable within the longer, with an equal token of four
    letters or more; what is left of the longer may be middle initials, an
    acronym of the shorter, or (dearer) generic words left out. Without orders
    the words stand as they are given.
    """
    if len(a) > len(b):
        a, b, orders_b = b, a, orders_a
        return _fits(a, b, orders_b)
    found = _fits(a, b, orders_b)
    if found is None and len(a) == len(b):
        found = _fits(b, a, orders_a)
    return found


def _fits(a: list[str], b: list[str], orders: Orders) -> float | None:
    """``orders`` are those of ``b``."""
    if not set(a) & set(b) or max(len(t) for t in set(a) & set(b)) < 4:
        return None
    got = assign(a, b)
    if got is None:
        # An acronym in the shorter stands for a row of words of the longer.
        for i, t in enumerate(a):
            if 2 <= len(t) <= 4 and len(a) > 1:
                rest = a[:i] + a[i + 1 :]
                inner = assign(rest, b)
                if inner is not None:
                    left = [y for j, y in enumerate(b) if j not in inner[2]]
                    if _is_acronym(t, left, orders):
                        return inner[0] + 0.5
        return None
    cost, _, used = got
    left = [y for j, y in enumerate(b) if j not in used]
    for y in left:
        if len(y) == 1 and len(a) >= 2:
            cost += 0.1
        elif _is_acronym(y, [t for t in b if t != y], orders):
            cost += 0.1
        elif len(a) >= 2 and min(len(t) for t in a) > 1:
            cost += 0.8
        else:
            return None
    return cost if cost <= 1.7 else None


def _full(tokens: list[str]) -> bool:
    return len(tokens) > 1 and all(len(t) > 1 for t in tokens)


def readings(signature: str, token: str) -> set[tuple[str, str]]:
    """``(reading, side)`` of the tokens beside ``token``.

    Two signatures that hold ``token`` and fit share a reading under different
    sides, or under the side ``=``. A signature of the one token fits no other.
    """
    rest = signature.split(" ")
    rest.remove(token)
    found: set[tuple[str, str]] = set()
    nick = _nicknames()
    for x in set(rest):
        found.add(("=" + x, "="))
        found |= {("n" + full, "<") for full in nick.get(x, ())}
        if x in _full_names():
            found.add(("n" + x, ">"))
        if len(x) == 1:
            found.add(("1" + x, "<"))
            continue
        found.add(("1" + x[0], ">"))
        if len(x) >= 3:
            found |= {("~" + d, x) for d in deletes(x, 1)}
        # Cut forms are beginnings; squeezed ones keep the first letter and the order.
        found.add(("p" + x, "<"))
        found |= {("p" + x[:k], ">") for k in range(2, len(x))}
        if squeezed(x):
            found.add(("s" + x[:3], "<"))
        found |= {("s" + x[0] + y, ">") for y in set(x[1:])}
        found |= {("s" + x[0] + y + z, ">") for y, z in set(combinations(x[1:], 2))}
        if len(rest) == 1 and len(x) <= 4:
            found.add(("a" + "".join(sorted(x)), "<"))
    # In whatever order the words were written.
    initials = "".join(sorted(_initials(rest)))
    if 2 <= len(rest) <= 4:
        found.add(("a" + initials, ">"))
    # The token itself may be read as another while another is read as it.
    if initials == "".join(sorted(token)) or any(token_cost(x, token) is not None for x in rest):
        found.add(("*", "="))
    return found


@lru_cache(maxsize=1)
def _full_names() -> frozenset[str]:
    return frozenset().union(*_nicknames().values())


def _sided(rows: list[tuple[str, str]]) -> Iterator[tuple[str, str]]:
    """Pairs of ``(side, signature)`` with one reading that may fit."""
    sides: dict[str, list[str]] = {}
    for side, signature in rows:
        sides.setdefault(side, []).append(signature)
    yield from combinations(sides.pop("=", ()), 2)
    for one, other in combinations(sides.values(), 2):
        yield from product(one, other)


def _orders(written: str | None) -> list[tuple[str, ...]]:
    """Orders are carried as lines."""
    return [tuple(x.split(" ")) for x in written.split("\n")] if written else []


def _costs(pairs: Iterable[tuple[str, str]], legal: dict[str, str], written: dict[str, str] | None = None) -> dict[tuple[str, str], float]:
    """``{(a, b): cost}`` of the pairs that fit, a < b; ``written`` holds the orders of the words."""
    split = {s: s.split(" ") for s in legal}
    orders = {s: _orders((written or {}).get(s)) for s in legal}
    cost: dict[tuple[str, str], float] = {}
    for a, b in pairs:
        if a > b:
            a, b = b, a
        if a == b or (a, b) in cost or legal[a] and legal[b] and legal[a] != legal[b]:
            continue
        c = fits(split[a], split[b], orders[a], orders[b])
        if c is not None:
            cost[a, b] = c
    return cost


def pair_block(signatures: list[tuple[str, str]], token: str, written: dict[str, str] | None = None) -> dict[tuple[str, str], float]:
    """Costs of all the pairs that fit among ``(signature, legal form)`` holding ``token``."""
    legal = dict(signatures)
    if len(legal) <= 40:
        return _costs(combinations(legal, 2), legal, written)
    index: dict[str, list[tuple[str, str]]] = {}
    for s in legal:
        for reading, side in readings(s, token):
            index.setdefault(reading, []).append((side, s))
    return _costs({(min(p), max(p)) for rows in index.values() if len(rows) > 1 for p in _sided(rows)}, legal, written)


def _unclear(others: dict[str, float], near: dict[str, set[str]]) -> bool:
    """Could a name that is not complete stand for more than one sender?

    All the complete names it fits must be one sender's: fit each other, or be
    joined by a third complete one. A complete name joins those it fits itself.
    """
    whole = [b for b in others if _full(b.split(" "))] or list(others)
    if not any(others[b] >= 0.3 for b in whole):
        return False
    full = {b: {z for z in near[b] if _full(z.split(" "))} for b in whole}
    return any(y not in near[x] and full[x].isdisjoint(full[y]) for x, y in combinations(whole, 2))


def link_block(signatures: list[tuple[str, str, int]], written: dict[str, str] | None = None) -> list[tuple[str, str]]:
    """Links among few ``(signature, legal form, rows)``, all pairs tried."""
    legal = {s: form for s, form, _ in signatures}
    cost = _costs(combinations(legal, 2), legal, written)
    near: dict[str, dict[str, float]] = {s: {} for s in legal}
    for (a, b), c in cost.items():
        near[a][b] = near[b][a] = c
    sets = {s: set(others) for s, others in near.items()}
    ambiguous = {s for s, others in near.items() if not _full(s.split(" ")) and _unclear(others, sets)}
    return sorted(p for p, c in cost.items() if c <= SURE or ambiguous.isdisjoint(p))


def _respell(tokens: DataFrame) -> DataFrame:
    """``(token, spelling)``: rare tokens and the frequent neighbour one edit away."""
    stats = tokens.groupBy("token").agg(F.countDistinct("name").alias("df"), F.sum("n").alias("n")).filter(F.length("token") >= 5)

    def keys(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(k, t, d, n) for t, d, n in zip(pdf["token"], pdf["df"], pdf["n"]) for k in deletes(t, 1)]
            yield pd.DataFrame(rows, columns=["key", "token", "df", "n"])

    index = materialize(stats.mapInPandas(keys, "key string, token string, df bigint, n bigint"), "deletions")
    left, right = index.alias("l"), index.alias("r")
    rarer = (F.col("l.df") < F.col("r.df")) | (
        (F.col("l.df") == F.col("r.df")) & ((F.col("l.n") < F.col("r.n")) | ((F.col("l.n") == F.col("r.n")) & (F.col("l.token") > F.col("r.token"))))
    )
    pairs = (
        left.join(right, F.col("l.key") == F.col("r.key"))
        .filter(rarer & (F.col("l.df") * 2 <= F.greatest(F.col("r.df"), F.lit(2))) & (F.col("l.df") * 5 <= F.col("r.df") + 8))
        .select(F.col("l.token").alias("token"), F.col("r.token").alias("spelling"), F.col("r.df").alias("df"), F.col("r.n").alias("n"))
        .distinct()
    )

    def near(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf[[(a[0] == b[0] or len(a) >= 8) and edits(a, b) == 1 for a, b in zip(pdf["token"], pdf["spelling"])]]

    best = pairs.mapInPandas(near, "token string, spelling string, df bigint, n bigint")
    return best.groupBy("token").agg(F.max_by("spelling", F.struct("df", "n", "spelling")).alias("spelling"))


def _signatures(names: DataFrame) -> DataFrame:
    """``(name, n, signature, legal, written)`` with tokens respelled; ``written`` has them in order."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            got = [parts(v) for v in pdf["name"]]
            yield pd.DataFrame({"name": pdf["name"], "n": pdf["n"], "tokens": [g[0] for g in got], "legal": [g[1] for g in got]})

    pieces = materialize(names.mapInPandas(cut, "name string, n bigint, tokens array<string>, legal string"), "tokens")
    tokens = pieces.select("name", "n", "legal", F.posexplode("tokens").alias("pos", "token"))
    respelled = materialize(_respell(tokens), "respelled")
    again = respelled.select(F.col("token").alias("spelling"), F.col("spelling").alias("further"))
    final = respelled.join(again, "spelling", "left").select("token", F.coalesce("further", "spelling").alias("spelling"))
    in_order = (
        tokens.join(final, "token", "left")
        .groupBy("name")
        .agg(F.first("n").alias("n"), F.first("legal").alias("legal"), F.array_sort(F.collect_list(F.struct("pos", F.coalesce("spelling", "token").alias("t")))).alias("x"))
    )
    words = F.col("x.t")
    return in_order.select("name", "n", F.array_join(F.array_sort(words), " ").alias("signature"), "legal", F.array_join(words, " ").alias("written"))


def _fitting(signatures: DataFrame) -> DataFrame:
    """``(a, b, cost)``, a < b: all the signatures that fit, found block by block."""
    tokens = signatures.select("signature", "legal", "written", F.explode(F.array_distinct(F.split("signature", " "))).alias("token"))
    tokens = tokens.filter((F.length("token") >= 4) & F.col("signature").contains(" "))
    df = tokens.groupBy("token").agg(F.count("*").alias("df")).filter("df > 1")
    block = materialize(tokens.join(df, "token"), "blocks")
    # Blocks cost far more than their bytes tell, so they are not left to coalescing.
    tasks = 4 * signatures.sparkSession.sparkContext.defaultParallelism
    schema = "a string, b string, cost double"

    def frame(cost: dict[tuple[str, str], float]) -> pd.DataFrame:
        return pd.DataFrame([(a, b, c) for (a, b), c in cost.items()], columns=["a", "b", "cost"])

    def whole(pdf: pd.DataFrame) -> pd.DataFrame:
        return frame(pair_block(list(zip(pdf["signature"], pdf["legal"])), pdf["token"].iat[0], dict(zip(pdf["signature"], pdf["written"]))))

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(t, d, *x, s, f, w) for t, d, s, f, w in zip(pdf["token"], pdf["df"], pdf["signature"], pdf["legal"], pdf["written"]) for x in readings(s, t)]
            yield pd.DataFrame(rows, columns=["token", "df", "reading", "side", "signature", "legal", "written"])

    def sided(pdf: pd.DataFrame) -> pd.DataFrame:
        index: dict[str, list[tuple[str, str]]] = {}
        for reading, side, signature in zip(pdf["reading"], pdf["side"], pdf["signature"]):
            index.setdefault(reading, []).append((side, signature))
        legal, written = (dict(zip(pdf["signature"], pdf[c])) for c in ("legal", "written"))
        return frame(_costs((p for rows in index.values() for p in _sided(rows)), legal, written))

    small = block.filter(F.col("df") <= BLOCK).repartition(tasks, "token").groupBy("token").applyInPandas(whole, schema)
    large = (
        block.filter(F.col("df") > BLOCK)
        .mapInPandas(read, "token string, df bigint, reading string, side string, signature string, legal string, written string")
        .withColumn("part", F.expr(f"pmod(xxhash64(reading), 1 + 4 * df div {BLOCK})"))
        .repartition(tasks, "token", "part")
        .groupBy("token", "part")
        .applyInPandas(sided, schema)
    )
    return small.unionByName(large).groupBy("a", "b").agg(F.min("cost").alias("cost"))


def _links(signatures: DataFrame) -> DataFrame:
    """``(a, b)`` between signatures: those that fit, without ambiguous ones."""
    fitting = materialize(_fitting(signatures), "fitting")
    both = fitting.union(fitting.select("b", "a", "cost"))
    near = both.groupBy("a").agg(F.collect_list("b").alias("near")).withColumnRenamed("a", "b")
    # Complete names are two words or more, none of them an initial.
    partial = ~F.col("a").contains(" ") | F.exists(F.split("a", " "), lambda t: F.length(t) == 1)

    def unclear(pdf: pd.DataFrame) -> pd.DataFrame:
        bad = _unclear(dict(zip(pdf["b"], pdf["cost"])), {b: set(n) for b, n in zip(pdf["b"], pdf["near"])})
        return pd.DataFrame({"name": pdf["a"].iloc[: int(bad)]})

    ambiguous = materialize(both.filter(partial).join(near, "b").select("a", "b", "cost", "near").groupBy("a").applyInPandas(unclear, "name string"), "ambiguous")
    loose = fitting.filter(F.col("cost") > SURE)
    clear = loose.join(ambiguous, loose["a"] == ambiguous["name"], "left_anti").join(ambiguous, F.col("b") == ambiguous["name"], "left_anti")
    return fitting.filter(F.col("cost") <= SURE).unionByName(clear).select("a", "b")


def _classes(signatures: DataFrame, links: DataFrame) -> DataFrame:
    """``(signature, class)``: the least signature reachable over links.

    Labels fall to the least of the neighbours' and then to their label's own
    label, so chains of any length are closed in few rounds; it ends when nothing
    changes.
    """
    both = materialize(links.union(links.select("b", "a")), "links")
    label = materialize(both.select(F.col("a").alias("signature")).distinct().withColumn("class", F.col("signature")), "classes")
    while True:
        lower = both.join(label, both["b"] == label["signature"]).groupBy("a").agg(F.min("class").alias("lower"))
        step = label.join(lower, label["signature"] == lower["a"]).select("signature", F.col("class").alias("was"), F.least("class", "lower").alias("class"))
        step = materialize(step, "lowered")
        jump = step.select(F.col("signature").alias("class"), F.col("class").alias("further"))
        step = step.join(jump, "class", "left").select("signature", "was", F.least("class", "further").alias("class"))
        step = materialize(step, "classes")
        label = step.select("signature", "class")
        if step.filter("class <> was").isEmpty():
            break
    return signatures.select("signature").distinct().join(label, "signature", "left").select(
        "signature", F.coalesce("class", "signature").alias("class")
    )


def link_names(df: DataFrame, name: str = "correspondent") -> DataFrame:
    """``(name, n, signature, class)`` for every distinct name that is not blank."""
    names = (
        df.select(F.col(name).alias("name"))
        .filter(F.length(F.regexp_replace("name", r"[\s\u00A0]+", "")) > 0)
        .groupBy("name")
        .agg(F.count("*").alias("n"))
    )
    spelled = materialize(_signatures(names), "spelled")
    signatures = spelled.groupBy("signature").agg(
        F.max("legal").alias("legal"), F.sum("n").alias("n"), F.array_join(F.array_sort(F.collect_set("written")), "\n").alias("written")
    )
    classes = _classes(signatures, _links(signatures))
    return spelled.join(classes, "signature").select("name", "n", "signature", "class")


def name_pairs(df: DataFrame, name: str = "correspondent") -> DataFrame:
    """``(name_a, name_b)``: different spellings of one class, each pair once."""
    linked = materialize(link_names(df, name).select("name", "class"), "linked")
    a = linked.select("class", F.col("name").alias("name_a"))
    b = linked.select("class", F.col("name").alias("name_b"))
    return a.join(b, "class").filter("name_a < name_b").select("name_a", "name_b")


def sender_index(df: DataFrame, name: str = "correspondent") -> DataFrame:
    """One row per spelling: the spelling its class is known by, and the class's size."""
    linked = link_names(df, name)
    by_class = linked.groupBy("class").agg(
        F.max_by("name", F.struct("n", "name")).alias("sender"), F.count("*").alias("spellings"), F.sum("n").alias("rows")
    )
    return linked.join(by_class, "class").select("name", "sender", "spellings", "rows")
