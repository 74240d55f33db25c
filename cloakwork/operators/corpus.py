"""Corpus scope: all documents share one dictionary, numbered in the order (document, rule, place) of first appearance.

1. Every document is redacted in a scope of its own (no shuffle) and says which identities it gave tokens, in order.
2. The dictionary keeps of each identity key the first appearance: its category, spelling and place. Spark aggregates before the shuffle.
3. Numbers: the keys are range-partitioned by category and place, numbered within their partition, and shifted by the sizes of the partitions before;
   the driver sees one number per partition and category. Numbers that texts already hold as foreign tokens are passed over.
4. The documents' own tokens are replaced by the corpus' tokens. A document's pairs of tokens are bounded by its own length.

Where a sequential run would differ: a name that only stands bare in one document is replaced there if `everywhere` is set, by a join of
the words of the texts with the dictionary's names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.grammar import TEMPLATES
from ..sources.storage import spread, stored
from .ledger import find_tokens, host_tokens
from .redact import Policy, _standalone, redact_text

_NUMBER = re.compile(r"_(\d+)(?=\]|$|/|\.)")
CATEGORIES = "part int, category string, n long"


def _own_tokens(docs: DataFrame, policy: Policy, id_col: str, order_col: str, text_col: str) -> DataFrame:
    """(id, ord, text, born, held): text with the document's own tokens; born: seq, category, key, original, token; held: category and number of its foreign tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, born, held = [], [], []
            for t in b.column(2).to_pylist():
                if t is None:
                    texts.append(None), born.append([]), held.append([])
                    continue
                ledger = policy.ledger()
                held.append([{"category": c, "n": n} for c, n in sorted({x for m in find_tokens(t) for x in numbers_of(m[0])})])
                text, log = redact_text(t, policy, ledger)
                first: dict[str, str] = {}
                for _, o, token in log:
                    first.setdefault(token, o)
                originals = ledger.originals()
                texts.append(text)
                born.append([{"seq": i, "category": c, "key": k, "original": first.get(token, originals.get(token, k)), "token": token} for i, (c, token, k) in enumerate(ledger.born)])
            kind = pa.list_(pa.struct([("seq", pa.int32()), ("category", pa.string()), ("key", pa.string()), ("original", pa.string()), ("token", pa.string())]))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array(born, kind), pa.array(held, pa.list_(pa.struct([("category", pa.string()), ("n", pa.int64())])))], ["id", "ord", "text", "born", "held"])

    d = spread(docs.select(F.col(id_col).alias("id"), F.col(order_col).cast("long").alias("ord"), F.col(text_col).alias("text")))
    return d.mapInArrow(run, f"id {d.schema['id'].dataType.simpleString()}, ord long, text string, born array<struct<seq:int,category:string,key:string,original:string,token:string>>, held array<struct<category:string,n:bigint>>")


_HEADS = [(c, t.split("{")[0]) for c, t in sorted(TEMPLATES.items()) if "{" in t]


def numbers_of(token: str) -> list[tuple[str, int]]:
    """(category, number) of each category whose own tokens could be spelt like this one."""
    if m := host_tokens.fullmatch(token):
        return [("hostname", int(m["a"] or m["b"]))]
    return [(c, int(n[0])) for c, head in _HEADS if token.startswith(head) and (n := re.match(r"\d+", token[len(head) :])) and len(n[0]) < 19]


def numbered(rows: DataFrame, by: str, order: list[str], name: str = "n", counted: str | None = None) -> DataFrame:
    """rows with a number from 1 within each value of `by`, in the given order: range partitions and prefix sums instead of one task per value.

    With `counted`, a condition, the number is that of the rows so far for which it holds. The driver sees one number per partition and value of `by`.
    """
    spark = rows.sparkSession
    rows = rows.withColumn("__one", F.lit(1) if counted is None else F.expr(counted).cast("int"))
    schema = rows.schema
    at, one = rows.columns.index(by), len(schema.names) - 1
    sorted_rows = rows.repartitionByRange(by, *order).sortWithinPartitions(by, *order)

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seen = TaskContext.get().partitionId(), {}
        for b in batches:
            numbers = []
            for v, more in zip(b.column(at).to_pylist(), b.column(one).to_pylist(), strict=True):
                seen[v] = seen.get(v, 0) + more
                numbers.append(seen[v])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([part] * b.num_rows, pa.int32()), pa.array(numbers, pa.int64())], [*schema.names, "__part", "__n"])

    first = stored(sorted_rows.mapInArrow(local, T.StructType([*schema.fields, T.StructField("__part", T.IntegerType()), T.StructField("__n", T.LongType())])), "numbered")
    shift: dict[str, int] = {}
    base = []
    for r in sorted(first.groupBy("__part", by).agg(F.max("__n").alias("m")).collect(), key=lambda r: r["__part"]):
        base.append((r["__part"], r[by], shift.get(r[by], 0)))
        shift[r[by]] = shift.get(r[by], 0) + r["m"]
    offsets = spark.createDataFrame(base, f"p int, c {schema[by].dataType.simpleString()}, shift long")
    joined = first.join(F.broadcast(offsets), (F.col("__part") == F.col("p")) & (F.col(by) == F.col("c")))  # a row per partition and category
    return joined.select(*schema.names[:-1], (F.col("__n") + F.col("shift")).alias(name))


def around_taken(ordinals: DataFrame, taken: DataFrame) -> DataFrame:
    """ordinals (key, category, n, ...) with n as the n-th number of its category that `taken` (category, n; distinct) doesn't hold.

    Below the i-th taken number t lie t - i free ones, so it moves each n above t - i on by one: how many do is a running count over both, in order.
    """
    free = numbered(taken, "category", ["n"], "i").select("category", (F.col("n") - F.col("i")).alias("place"))
    columns = [c for c in ordinals.columns if c not in ("category", "n")]
    both = ordinals.select("category", F.col("n").alias("place"), F.lit(0).alias("kind"), F.struct(*columns).alias("row"))
    both = both.unionByName(free.select("category", "place", F.lit(1).alias("kind")), allowMissingColumns=True)
    moved = numbered(both, "category", ["place", "kind"], "before", "kind = 1").filter("kind = 0")
    return moved.select("row.*", "category", (F.col("place") + F.col("before")).alias("n"))


def dictionary(own: DataFrame) -> DataFrame:
    """(key, category, ordinal, placeholder, original) of all identities of the corpus."""
    born = own.select("ord", F.explode("born").alias("b")).select("ord", "b.*")
    first = born.groupBy("key").agg(F.min(F.struct("ord", "seq", "category", "original", "token")).alias("f")).select("key", F.col("f.category").alias("category"), F.col("f.ord").alias("ord"), F.col("f.seq").alias("seq"), F.col("f.original").alias("original"), F.col("f.token").alias("token"))
    out = numbered(first, "category", ["ord", "seq"])
    taken = stored(own.select(F.explode("held").alias("h")).select("h.*").distinct(), "taken")
    if not taken.isEmpty():
        out = around_taken(out, taken)
    out = out.withColumnRenamed("n", "ordinal")
    return out.select("key", "category", "ordinal", token_with("token", "ordinal").alias("placeholder"), "original")


def token_with(token, number):
    """The token with another number, padded as before."""
    t = F.col(token) if isinstance(token, str) else token
    n = F.col(number) if isinstance(number, str) else number
    old = F.regexp_extract(t, r"_(\d+)(?=\]|$|/)", 1)
    digits = F.when(F.contains(t, F.lit("[")), F.lit(4)).otherwise(F.lit(2))
    shown = F.when(F.length(n.cast("string")) >= digits, n.cast("string")).otherwise(F.lpad(n.cast("string"), digits, F.lit("0")))
    return F.when(old == "", t).otherwise(F.regexp_replace(t, F.lit(r"_\d+(?=\]|$|/)"), F.concat(F.lit("_"), shown)))


def redact_corpus(docs: DataFrame, policy: Policy | None = None, *, id_col: str = "doc_id", order_col: str = "doc_id", text_col: str = "text", everywhere: bool = False) -> tuple[DataFrame, DataFrame]:
    """(documents: id, redacted), (dictionary: key, category, ordinal, placeholder, original)."""
    policy = policy or Policy()
    own = stored(_own_tokens(docs, policy, id_col, order_col, text_col), "own-tokens")
    words = stored(dictionary(own), "dictionary")
    born = own.select("id", "ord", F.explode("born").alias("b")).select("id", "ord", F.col("b.key").alias("k"), F.col("b.token").alias("token"))
    pairs = born.join(words, born["k"] == words["key"]).select("id", "ord", "token", "ordinal", "category", "placeholder")
    changes = pairs.groupBy("id", "ord").agg(F.collect_list(F.struct("token", "ordinal", "category", "placeholder")).alias("changes")).select(F.col("id").alias("i"), F.col("ord").alias("o"), "changes")
    joined = own.select("id", "ord", "text").join(changes, own["id"].eqNullSafe(F.col("i")) & own["ord"].eqNullSafe(F.col("o")), "left").select("id", "text", "changes")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for text, changes in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                out.append(text if not changes or text is None else renamed(text, changes))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.string())], ["id", "redacted"])

    shown = joined.mapInArrow(run, f"id {own.schema['id'].dataType.simpleString()}, redacted string")
    if everywhere:
        shown = _everywhere(stored(shown, "shown"), words)
    return shown.withColumnRenamed("id", id_col), words


def renamed(text: str, changes: list[dict]) -> str:
    """A document's own tokens as the corpus' ones; host tokens change by number, so that both their forms do. An identity that another
    document met first under another category takes the token of that one."""
    tokens, hosts = {}, {}
    for c in changes:
        m = host_tokens.fullmatch(c["token"])
        if m and c["category"] == "hostname":
            hosts[int(m["a"] or m["b"])] = c["ordinal"]
        else:
            head = c["token"][: c["token"].rindex("_")].rpartition("[")[2]
            same = head == c["placeholder"][: c["placeholder"].rindex("_")].rpartition("[")[2]
            tokens[c["token"]] = _with_number(c["token"], c["ordinal"]) if same else c["placeholder"]

    def put(m: re.Match) -> str:
        t = m[0]
        if t in tokens:
            return tokens[t]
        h = host_tokens.fullmatch(t)
        if h and (n := hosts.get(int(h["a"] or h["b"]))):
            return _with_number(t, n)
        return t

    if not tokens and not hosts:
        return text
    exact = "|".join(map(re.escape, sorted(tokens, key=len, reverse=True)))
    shape = r"\[HOST(?:_SHORT)?_REDACTED_\d+\]"
    return re.sub(f"(?:{exact}|{shape})(?!\\d)" if exact else shape, put, text)


def _with_number(token: str, n: int) -> str:
    width = 4 if "[" in token else 2
    return _NUMBER.sub(f"_{n:0{width}d}", token, count=1)


#: Bytes of names up to which they are sent to all tasks; more are joined by a shuffle of both sides.
NAMES_BYTES = 16 << 20


def _everywhere(shown: DataFrame, words: DataFrame) -> DataFrame:
    """Names of the dictionary that still stand bare in some document are replaced there too: the texts' words are joined with the names.

    As long as the names are few, words that are none of them leave before any shuffle.
    """
    names = words.filter("category in ('hostname', 'ad_domain_user', 'domain') and length(key) between 4 and 80").filter(F.col("key").rlike(r"^[a-zA-Z0-9._$-]+$"))
    names = stored(names.groupBy(F.lower("key").alias("w")).agg(F.min(F.struct("key", "placeholder")).alias("hit")), "names")
    size = names.agg(F.sum(F.octet_length("w") + F.octet_length("hit.key") + F.octet_length("hit.placeholder") + 64)).first()[0] or 0
    found = shown.select("id", F.explode(F.array_distinct(F.flatten(F.array(F.regexp_extract_all(F.lower("redacted"), F.lit(r"[a-z0-9._$-]{4,80}"), F.lit(0)), F.regexp_extract_all(F.lower("redacted"), F.lit(r"[a-z0-9_$-]{4,80}"), F.lit(0)))))).alias("word"))
    found = found.join(F.broadcast(names) if size <= NAMES_BYTES else names.hint("merge"), F.rtrim(F.col("word"), F.lit(".")) == F.col("w"))
    hits = found.groupBy("id").agg(F.collect_set("hit").alias("hits")).select(F.col("id").alias("i"), "hits")
    joined = shown.join(hits, shown["id"].eqNullSafe(F.col("i")), "left").select("id", "redacted", "hits")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for text, hits in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                if hits and text is not None:
                    values = {h["key"].casefold(): (h["key"], h["placeholder"]) for h in hits}
                    domains = {k: v for k, v in values.items() if v[1].startswith("[DOMAIN_")}
                    text = _standalone(text, domains, True, [])
                    text = _standalone(text, {k: v for k, v in values.items() if k not in domains}, False, [])
                out.append(text)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.string())], ["id", "redacted"])

    return joined.mapInArrow(run, f"id {shown.schema['id'].dataType.simpleString()}, redacted string")


def merge_dictionaries(known: DataFrame, imported: DataFrame) -> DataFrame:
    """(key, placeholder): imported keys win."""
    both = known.select("key", "placeholder", F.lit(1).alias("order")).unionByName(imported.select("key", "placeholder", F.lit(0).alias("order")))
    return both.groupBy("key").agg(F.min_by("placeholder", "order").alias("placeholder"))
