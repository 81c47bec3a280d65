"""Language identification by fusion of evidence: text, declared language, address suffix and host."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from stipple.llm import html
from stipple.llm.common import cut, kind_of, prepare, table

#: Bits of the hash of a byte trigram.
BITS = 15
#: Labelled texts of each language, about, from which the text model learns: a sample by a hash of the id.
SAMPLE = 1000
#: A text speaks through its trigrams, which depend on each other: all of them together weigh as so many at most.
TRIGRAMS = 60.0
#: Strength of the smoothing of a host by its domain, of a domain by its suffix, and of that by the whole.
PRIOR = 20.0
#: Below this probability a language counts as not recognised.
LEAST = 0.5
#: Hosts (or declarations, or suffixes) whose numbers all workers hold, those of the most texts; others are joined.
BROADCAST_HOSTS = 100_000
_CHUNK = 1 << 20


def trigrams(data: bytes) -> np.ndarray:
    b = np.frombuffer(data, np.uint8).astype(np.uint32)
    return ((b[:-2] << 16 | b[1:-1] << 8 | b[2:]) * np.uint32(0x9E3779B1)) >> np.uint32(32 - BITS)


def letters(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


class TextModel:
    """Naive Bayes over hashed byte trigrams, one added to each count."""

    def __init__(self, langs: list[str], counts: np.ndarray):
        self.langs = langs
        self.logs = np.empty(counts.shape, np.float32)
        for k in range(len(langs)):  # one by one, as there may be many languages
            own = counts[:, k] + 1.0
            self.logs[:, k] = np.log(own / own.sum())

    def __call__(self, text: str | None) -> np.ndarray:
        """Log likelihoods, scaled to TRIGRAMS, of a text between spaces; zeros for one without letters."""
        out, n = np.zeros(len(self.langs)), 0
        if letters(text):
            data = f" {text.lower()} ".encode("utf-8", "surrogatepass")
            for at in range(0, len(data) - 2, _CHUNK):
                t = trigrams(data[at : at + _CHUNK + 2])
                out += self.logs[t].sum(0, dtype=np.float64)
                n += len(t)
        return out * min(1.0, TRIGRAMS / n) if n else out


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    of: dict[str, np.ndarray] = {}
    for b in batches:
        for text, lang in zip(b.column("text").to_pylist(), b.column("declared").to_pylist(), strict=True):
            if letters(text):
                data = f" {text.lower()} ".encode("utf-8", "surrogatepass")
                of.setdefault(lang, np.zeros(1 << BITS, np.int64))
                for at in range(0, len(data) - 2, _CHUNK):
                    of[lang] += np.bincount(trigrams(data[at : at + _CHUNK + 2]), minlength=1 << BITS)
    for lang, counts in of.items():
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(counts[at])], names=["lang", "gram", "n"])


def _source(docs: DataFrame, text: str, declared: str | None, address: str | None, host: str | None, keep: tuple[str, ...]) -> DataFrame:
    """text, declared (lower-cased primary subtag), suffix, domain, host, and a struct of the columns to keep."""
    null = F.lit(None).cast("string")
    name = lambda c: F.col(f"`{c}`").cast("string")
    blank = lambda c: F.when(c != "", c)
    said = blank(F.lower(F.regexp_extract(F.trim(name(declared)), r"^([A-Za-z]{2,8})(?:[-_].*)?$", 1))) if declared else null
    own = blank(F.lower(F.regexp_extract(name(address), r"^(?:[a-zA-Z][A-Za-z0-9+.-]*://)?(?:[^/?#@]*@)?([^/?#:]+)", 1))) if address else null
    if host:
        own = F.coalesce(own, blank(F.lower(F.trim(name(host)))))
    labels = F.split("host", r"\.")
    dots = F.size(labels) > 1
    out = docs.select(name(text).alias("text"), said.alias("declared"), own.alias("host"), F.struct(*[F.col(f"`{c}`") for c in keep]).alias("kept"))
    return out.withColumns({"suffix": F.when(dots, F.element_at(labels, -1)), "domain": F.when(dots, F.concat_ws(".", F.slice(labels, -2, 2)))})


def train(src: DataFrame) -> TextModel:
    """Learn trigrams from a sample of the texts that declare their language: about SAMPLE for each language."""
    sizes = {r["declared"]: r["n"] for r in src.filter("declared is not null").groupBy("declared").agg(F.count(F.lit(1)).alias("n")).collect()}
    langs = sorted(sizes)
    if not langs:
        return TextModel(["und"], np.zeros((1 << BITS, 1)))
    share = F.create_map(*[F.lit(x) for lang in langs for x in (lang, min(1.0, SAMPLE / sizes[lang]))])
    drawn = F.pmod(F.xxhash64(F.lit(31), "kept", "text"), F.lit(1 << 30)) / float(1 << 30)
    rows = src.filter(F.col("declared").isin(langs)).filter(drawn < share[F.col("declared")]).select("text", "declared")
    counts, at = np.zeros((1 << BITS, len(langs))), {lang: k for k, lang in enumerate(langs)}
    for lang, gram, n in rows.mapInArrow(_count, "lang string, gram int, n long").groupBy("lang", "gram").agg(F.sum("n")).toLocalIterator():
        counts[gram, at[lang]] += n
    return TextModel(langs, counts)


def identify(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), text_col: str = "text", declared_col: str | None = "lang", address_col: str | None = None, host_col: str | None = "source") -> DataFrame:
    """The language of every text, from all that speaks for it.

    Returns one row for each input row: the columns ``keep`` in a struct ``kept`` and ``detected`` string,
    ``posterior`` double, ``text_lang`` string (by the text alone), ``declared`` string and ``rejected`` boolean.

    posterior(l) is in proportion to P(l | host) P(text | l) P(declared | l) P(suffix | l).  The tables of the last
    two and the host's counts come from grouped counts of the texts' own verdicts; a host's shares are smoothed by
    its domain's, these by its suffix's, these by the whole.  A text is rejected if it has no letters (null, empty,
    digits only) or no language reaches LEAST; ``detected`` is then null, as are texts' verdicts without letters.
    Nulls of the other columns are no evidence.  An empty table gives none; repeated rows are judged each, ties go
    to the first language of the alphabet.  Only the named columns are read.
    """
    spark = docs.sparkSession
    prepare(spark)
    src = _source(docs, text_col, declared_col, address_col, host_col, keep)
    model = train(src)
    langs = model.langs
    shared = spark.sparkContext.broadcast(model)

    def verdicts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            got = []
            for text in b.column("text").to_pylist():
                ll = m(text)
                got.append(m.langs[int(ll.argmax())] if letters(text) else None)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("host", "domain", "suffix", "declared")), pa.array(got, pa.string())], names=["host", "domain", "suffix", "declared", "verdict"])

    counted = cut(src.select("host", "domain", "suffix", "declared", "text").mapInArrow(verdicts, "host string, domain string, suffix string, declared string, verdict string").filter("verdict is not null").groupBy("host", "domain", "suffix", "declared", "verdict").agg(F.count(F.lit(1)).alias("n")))

    names = F.array(*map(F.lit, langs))

    def evidence(name: str) -> DataFrame:
        """log P(value | language) of every value: one added to each count, and a value more for those not seen."""
        rows = counted.filter(F.col(name).isNotNull())
        sums = {r["verdict"]: r["n"] for r in rows.groupBy("verdict").agg(F.sum("n").alias("n")).collect()}
        of = cut(rows.groupBy(name, "verdict").agg(F.sum("n").alias("n")).groupBy(name).agg(F.map_from_entries(F.collect_list(F.struct("verdict", "n"))).alias("of"), F.sum("n").alias("texts")))
        values = of.count()
        whole = F.array(*[F.lit(float(sums.get(x, 0) + values + 1)) for x in langs])
        return of.select(name, "texts", F.zip_with(names, whole, lambda x, total: F.log((F.coalesce(F.col("of")[x], F.lit(0)) + 1.0) / total)).alias(f"{name}_logs"))

    def joined(rows: DataFrame, of: DataFrame, name: str) -> DataFrame:
        """Rows with what is known of their value; the most frequent values go to all workers, so that none is a hot key."""
        of = cut(of)
        few = of if of.count() <= BROADCAST_HOSTS else cut(of.orderBy(F.desc("texts"), name).limit(BROADCAST_HOSTS))
        wide = [c for c in of.columns if c not in (name, "texts")]
        if few is of:
            return rows.join(F.broadcast(of.drop("texts")), name, "left")
        met = rows.join(F.broadcast(few.select(name, F.lit(True).alias("met"), *wide)), name, "left")
        rest = met.filter("met is null").drop("met", *wide).join(of.join(F.broadcast(few.select(name)), name, "left_anti").drop("texts"), name, "left")
        return met.filter("met").drop("met").unionByName(rest)

    def level(*by: str) -> DataFrame:
        own = counted.filter(F.col(by[0]).isNotNull()).groupBy(*by, "verdict").agg(F.sum("n").cast("double").alias("n"))
        of = own.groupBy(*by).agg(F.map_from_entries(F.collect_list(F.struct("verdict", "n"))).alias("of"), F.sum("n").alias("texts"))
        return of.select(*by, *(["texts"] if by[0] == "host" else []), F.transform(names, lambda lang: F.coalesce(F.col("of")[lang], F.lit(0.0))).alias(f"n_{by[0]}"))

    def smooth(counts: Column, prior: Column) -> Column:
        total = F.aggregate(counts, F.lit(0.0), lambda a, x: a + x)
        return F.when(counts.isNull(), prior).otherwise(F.zip_with(counts, prior, lambda n, p: (n + PRIOR * p) / (total + PRIOR)))

    whole = {r["verdict"]: r["n"] for r in counted.groupBy("verdict").agg(F.sum("n").alias("n")).collect()}
    base = np.array([whole.get(x, 0) + 1.0 for x in langs])
    base /= base.sum()
    top = F.array(*map(F.lit, base.tolist()))
    priors = level("host", "domain", "suffix").join(level("domain", "suffix"), ["domain", "suffix"], "left").join(level("suffix"), "suffix", "left").select("host", "texts", smooth(F.col("n_host"), smooth(F.col("n_domain"), smooth(F.col("n_suffix"), top))).alias("prior"))
    judged = src.select("text", "declared", "host", "suffix", "kept")
    for name, of in (("host", priors), ("declared", evidence("declared")), ("suffix", evidence("suffix"))):
        judged = joined(judged, of, name)

    def fuse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            lang, sure, alone, gone = [], [], [], []
            for text, p, *more in zip(*(b.column(c).to_pylist() for c in ("text", "prior", "declared_logs", "suffix_logs")), strict=True):
                if not letters(text):
                    lang.append(None), sure.append(None), alone.append(None), gone.append(True)
                    continue
                ll = m(text)
                x = ll + np.log(np.array(p) if p else base)
                for logs in more:
                    if logs:
                        x = x + np.array(logs)
                best = int(x.argmax())
                share = 1.0 / float(np.exp(x - x[best]).sum())
                alone.append(m.langs[int(ll.argmax())]), sure.append(share), gone.append(share < LEAST)
                lang.append(m.langs[best] if share >= LEAST else None)
            yield pa.RecordBatch.from_arrays([b.column("kept"), pa.array(lang, pa.string()), pa.array(sure, pa.float64()), pa.array(alone, pa.string()), b.column("declared"), pa.array(gone, pa.bool_())], names=["kept", "detected", "posterior", "text_lang", "declared", "rejected"])

    return judged.mapInArrow(fuse, f"kept {kind_of(src.schema['kept'].dataType)}, detected string, posterior double, text_lang string, declared string, rejected boolean")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op3: the language of every document; its source stands for the host, `lang` for the declaration."""
    return identify(table(spark, sf_dir, "documents")).select(F.col("kept.doc_id").alias("doc_id"), "detected", F.round("posterior", 6).alias("posterior"), "text_lang", "declared", "rejected")


@F.arrow_udf(returnType=StringType())
def page_text(pages: pa.Array) -> pa.Array:
    """The text of a page as its own elements tell it; all its text if they leave none."""
    out = []
    for page in pages.to_pylist():
        blocks = html.parse(page or "")[0]
        out.append(html.main_text(blocks, html.Template(0, [])) or "\n\n".join(b[1] for b in blocks))
    return pa.array(out, pa.string())


def markup_lang(page: Column) -> Column:
    """What the html element of a page declares as its language; null if nothing."""
    said = F.regexp_extract(page, r"""(?i)<html\b[^>]*?\s(?:xml:)?lang\s*=\s*["']?\s*([a-z][a-z0-9_-]*)""", 1)
    return F.when(said != "", said)


def identify_pages(pages: DataFrame) -> DataFrame:
    """`identify` on web pages (page_id, url, html): declared in their markup, with suffix and host from the url."""
    prepare(pages.sparkSession)
    src = pages.select("page_id", "url", page_text("html").alias("text"), markup_lang(F.col("html")).alias("lang"))
    return identify(src, ("page_id",), address_col="url", host_col=None)


def query_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op3: the language of every page, from its text, the markup's declaration, the address suffix and the host."""
    return identify_pages(table(spark, sf_dir, "pages")).select(F.col("kept.page_id").alias("page_id"), "detected", F.round("posterior", 6).alias("posterior"), "text_lang", "declared", "rejected")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline: documents whose language is recognised, unchanged; nulls, ties and repeats as in `identify`."""
    return identify(docs, tuple(docs.columns)).filter("not rejected").select("kept.*")
