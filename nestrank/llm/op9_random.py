"""Secret scan with a battery of randomness tests; DataFrame functions only.

Base spans follow three fixed patterns (``assign``, ``access``, ``hex``). The battery adds spans
``random``: a candidate is a run of 20 or more characters of base64 (either alphabet). From its
characters an encoding is inferred: ``hex`` (16 symbols), ``base32`` (32) or ``base64`` (64); a
run of one class alone (only lower case, only digits, ...) is text or a number, not an encoding.
Three tests of the hypothesis "symbols are drawn at random from the alphabet" follow:

* chi-squared uniformity of the symbol counts (Wilson-Hilferty normal form),
* runs above and below the middle of the alphabet,
* serial correlation of neighbouring symbol values.

Fisher's sum combines the p-values. Benjamini-Hochberg over all candidates of the corpus decides
which ones are *not* random, separately for each encoding and length band, since short runs test
weakly and must not set the bar of long ones. What stays un-rejected is a secret. The ranks come
from a histogram of log10 p (bands x encodings x ``BINS`` rows at most), so no candidate list is
sorted or gathered; the driver sees one bound per band and encoding, 12 numbers.

Defined results: null counts as empty text; empty text has no spans; spans are code points, end
exclusive; base spans are cut out of a candidate, with one joining character (/ _ - + =) at each cut,
and what remains in runs of 20 or more characters is tested run by run; rows with null or repeated
ids are scanned one by one. Only ``id_col`` and ``text_col`` are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nestrank.llm.common import staged

# The three base patterns.
ASSIGN = (
    r"(?i:(password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
)
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
# Longest-run forms of the two open patterns: a maximal run under the minimum length never holds
# a match that counts, so the bound can stand in the pattern.
ACCESS_LONG = r"AKIA[A-Z0-9]{16,}"
HEX_LONG = r"[0-9a-f]{24,}"
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
KINDS = ("assign", "access", "hex", "random")
ALPHABETS = {
    "hex": "0123456789abcdef",
    "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567",
    "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/",
}
LENGTH_BANDS = (32, 48, 96)
BINS = 1200  # of log10 p, a hundredth each
ALPHA = 0.01
PIECE = 256  # spans that one growing array holds
SPAN = "struct<start:bigint,end:bigint,hit:string>"


def _pieces(items: Column, use) -> Column:
    """``use`` of each run of ``PIECE`` items, in order: arrays that grow stay short."""
    def cut(all_items: Column) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.size(all_items), F.lit(1)), F.lit(PIECE))
        return F.transform(starts, lambda at: use(F.slice(all_items, at, F.lit(PIECE))))

    return _let(items, cut)


def _empty(kind: str) -> Column:
    return F.expr("array()").cast(f"array<{kind}>")


def _found(text: Column, pattern: str, possible: Column) -> Column:
    """array<struct<start, end, hit>> of the leftmost non-overlapping matches.

    The pieces between the matches and the matches themselves give the positions, in code points.
    """
    none = _empty(SPAN)
    between = F.split(text, pattern, -1)
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + x["gap"]
        end = start + F.length(x["hit"])
        return F.struct(
            end.alias("at"),
            F.concat(acc["out"], F.array(F.struct(start.alias("start"), end.alias("end"), x["hit"].alias("hit")))).alias("out"),
        )

    def local(part: Column) -> Column:
        return F.aggregate(part, F.struct(F.lit(0).cast("long").alias("at"), none.alias("out")), step)

    def moved(acc: Column, x: Column) -> Column:
        return F.struct((acc["at"] + x).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out"))

    def placed(parts: Column) -> Column:
        shifts = F.aggregate(
            F.transform(parts, lambda p: p["at"]),
            F.struct(F.lit(0).cast("long").alias("at"), _empty("bigint").alias("out")), moved, lambda acc: acc["out"],
        )
        return F.flatten(F.zip_with(parts, shifts, lambda p, by: F.transform(
            p["out"],
            lambda x: F.struct((x["start"] + by).alias("start"), (x["end"] + by).alias("end"), x["hit"].alias("hit")),
        )))

    zipped = F.zip_with(
        F.slice(between, F.lit(1), F.size(hits)), hits, lambda p, h: F.struct(F.length(p).alias("gap"), h.alias("hit"))
    )
    spans = _let(zipped, lambda z: _let(_pieces(z, local), placed))
    return F.when(possible, spans).otherwise(none)


def _upper(z: Column) -> Column:
    """P(Z > z) of the normal law (Abramowitz-Stegun 26.2.17, to 1e-7)."""
    t = 1 / (1 + 0.2316419 * F.abs(z))
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    tail = F.exp(-z * z / 2) * 0.3989422804014327 * poly
    return F.when(z >= 0, tail).otherwise(1 - tail)


def _fields(**columns: Column) -> Column:
    return F.struct(*[c.alias(n) for n, c in columns.items()])


def _let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once."""
    return F.transform(F.array(value), use)[0]


def battery(token: Column) -> Column:
    """struct<encoding, size, logp> of one candidate; null if no encoding is inferred."""
    bare = F.translate(F.regexp_replace(token, "=+$", ""), "-_", "+/")
    lower, upper, digit = (bare.rlike(f"[{c}]") for c in ("a-z", "A-Z", "0-9"))
    classes = lower.cast("int") + upper.cast("int") + digit.cast("int")
    encoding = (
        F.when(classes < 2, F.lit(None).cast("string"))
        .when(bare.rlike("^(?:[0-9a-f]+|[0-9A-F]+)$"), "hex")
        .when(bare.rlike("^[A-Z2-7]+$"), "base32")
        .otherwise("base64")
    )

    def measured(x: Column) -> Column:
        word = F.when(x["encoding"] == "hex", F.lower(x["bare"])).otherwise(x["bare"])
        alphabet = F.when(x["encoding"] == "hex", ALPHABETS["hex"]).when(
            x["encoding"] == "base32", ALPHABETS["base32"]
        ).otherwise(ALPHABETS["base64"])
        return _let(
            _fields(encoding=x["encoding"], word=word, alphabet=alphabet),
            lambda y: _let(
                _fields(
                    encoding=y["encoding"],
                    n=F.length(y["word"]).cast("double"),
                    a=F.length(y["alphabet"]).cast("double"),
                    values=F.transform(
                        F.filter(F.split(y["word"], ""), lambda c: c != ""),
                        lambda c: (F.instr(y["alphabet"], c) - 1).cast("double"),
                    ),
                    squares=F.aggregate(
                        F.transform(
                            F.sequence(F.lit(1), F.length(y["alphabet"])),
                            lambda k: F.length(y["word"])
                            - F.length(F.replace(y["word"], F.substr(y["alphabet"], k, F.lit(1)), F.lit(""))),
                        ),
                        F.lit(0.0), lambda s, c: s + c * c,
                    ),
                ),
                _tests,
            ),
        )

    return F.when(encoding.isNotNull(), _let(_fields(encoding=encoding, bare=bare), measured))


def _tests(x: Column) -> Column:
    n, a, values = x["n"], x["a"], x["values"]
    inner = n.cast("int") - 1
    first, second = F.slice(values, F.lit(1), inner), F.slice(values, F.lit(2), inner)
    total = F.aggregate(values, F.lit(0.0), lambda s, v: s + v)
    square = F.aggregate(values, F.lit(0.0), lambda s, v: s + v * v)
    above = F.aggregate(values, F.lit(0.0), lambda s, v: s + (v >= a / 2).cast("double"))
    changes = F.aggregate(
        F.zip_with(first, second, lambda p, q: ((p >= a / 2) != (q >= a / 2)).cast("double")),
        F.lit(0.0), lambda s, v: s + v,
    )
    products = F.aggregate(F.zip_with(first, second, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)
    sums = _fields(
        encoding=x["encoding"], n=n, a=a, squares=x["squares"], total=total, square=square, above=above,
        changes=changes, products=products, head=values[0], tail=F.element_at(values, -1),
    )

    def combined(y: Column) -> Column:
        size, k = y["n"], y["a"] - 1
        chi = y["a"] / size * y["squares"] - size
        z_chi = (F.cbrt(chi / k) - (1 - 2 / (9 * k))) / F.sqrt(2 / (9 * k))
        pairs = 2 * y["above"] * (size - y["above"]) / size
        var_runs = pairs * (pairs - 1) / (size - 1)
        z_runs = F.when(var_runs > 0, (y["changes"] - pairs) / F.sqrt(var_runs)).otherwise(F.lit(9.0))
        mean = y["total"] / size
        spread = y["square"] - size * mean * mean
        # sum over neighbours of (p - mean)(q - mean)
        cross = y["products"] - mean * (2 * y["total"] - y["head"] - y["tail"]) + (size - 1) * mean * mean
        z_serial = F.when(spread > 0, (cross / spread + 1 / size) * F.sqrt(size)).otherwise(F.lit(9.0))
        logs = (
            F.ln(F.greatest(_upper(z_chi), F.lit(1e-12)))
            + F.ln(F.greatest(F.least(2 * _upper(F.abs(z_runs)), F.lit(1.0)), F.lit(1e-12)))
            + F.ln(F.greatest(F.least(2 * _upper(F.abs(z_serial)), F.lit(1.0)), F.lit(1e-12)))
        )
        return _let(
            -logs,
            lambda h: _fields(
                encoding=y["encoding"],
                size=size.cast("int"),
                logp=(-h + F.ln(1 + h + h * h / 2)) / 2.302585092994046,  # Fisher: chi-squared of 6 degrees
            ),
        )

    return _let(sums, combined)


def _band(size: Column) -> Column:
    band = F.lit(0)
    for limit in LENGTH_BANDS:
        band = band + (size >= limit).cast("int")
    return band


def _mixed(x: Column) -> Column:
    return x["hit"].rlike("[0-9]") | (x["hit"].rlike("[A-Z]") & x["hit"].rlike("[a-z]"))


def _outside(x: Column, base: Column) -> Column:
    """Runs of 20 or more characters of the candidate ``x`` outside the base spans.

    ``base`` holds pieces of the sorted base spans, each with the range that it covers.
    """
    def overlaps(b: Column) -> Column:
        return (b["start"] < x["end"]) & (x["start"] < b["end"])

    def cut(near: Column) -> Column:
        return F.when(F.size(near) > 0, _remaining(x, near)).otherwise(F.array(x))

    near = F.flatten(F.transform(F.filter(base, overlaps), lambda p: F.filter(p["spans"], overlaps)))
    return _let(near, cut)


def _remaining(x: Column, near: Column) -> Column:
    def step(acc: Column, b: Column) -> Column:
        gap = F.struct(acc["at"].alias("start"), b["start"].alias("end"))
        return F.struct(F.greatest(acc["at"], b["end"]).alias("at"), F.concat(acc["out"], F.array(gap)).alias("out"))

    def joiner(at: Column) -> Column:
        return F.substring(x["hit"], (at - x["start"] + 1).cast("int"), F.lit(1)).rlike("[/_+=-]").cast("int")

    gaps = F.aggregate(
        near,
        F.struct(x["start"].alias("at"), _empty("struct<start:bigint,end:bigint>").alias("out")),
        step,
        lambda acc: F.concat(acc["out"], F.array(F.struct(acc["at"].alias("start"), x["end"].alias("end")))),
    )
    trimmed = F.transform(
        F.filter(gaps, lambda g: g["end"] - g["start"] >= 20),
        lambda g: F.struct(
            (g["start"] + F.when(g["start"] > x["start"], joiner(g["start"])).otherwise(0)).alias("start"),
            (g["end"] - F.when(g["end"] < x["end"], joiner(g["end"] - 1)).otherwise(0)).alias("end"),
        ),
    )
    return F.transform(
        F.filter(trimmed, lambda g: g["end"] - g["start"] >= 20),
        lambda g: F.struct(
            g["start"].alias("start"), g["end"].alias("end"),
            F.substring(x["hit"], (g["start"] - x["start"] + 1).cast("int"), (g["end"] - g["start"]).cast("int")).alias("hit"),
        ),
    )


def scanned(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs``, which has none of these columns, with ``_base`` (kind, start, end) and ``_tokens`` (start, end, encoding, size, logp)."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    assign = F.filter(
        _found(text, ASSIGN, text.rlike(r"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]")),
        lambda x: F.length(F.regexp_extract(x["hit"], ASSIGN, 2)) >= 6,
    )
    access = _found(text, ACCESS_LONG, text.contains("AKIA"))
    hexes = _found(text, HEX_LONG, text.rlike("[0-9a-f]{24}"))
    tokens = _found(text, CANDIDATE, text.rlike("[A-Za-z0-9+/_=-]{20}"))

    def tagged(found: Column, kind: int) -> Column:
        return F.transform(
            found, lambda x: F.struct(x["start"].alias("start"), F.lit(kind).alias("kind"), x["end"].alias("end"))
        )

    base = F.array_sort(F.concat(tagged(assign, 0), tagged(access, 1), tagged(hexes, 2)))
    covered = _pieces(F.col("_base"), lambda part: F.struct(
        F.array_min(F.transform(part, lambda b: b["start"])).alias("start"),
        F.array_max(F.transform(part, lambda b: b["end"])).alias("end"),
        part.alias("spans"),
    ))
    runs = _let(covered, lambda pieces: F.flatten(F.transform("_found", lambda x: _outside(x, pieces))))
    return docs.withColumn("_base", base).withColumn("_found", tokens).withColumn(
        "_runs", F.filter(runs, _mixed)
    ).withColumn(
        "_tokens",
        F.filter(
            F.transform(
                "_runs",
                lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), battery(x["hit"]).alias("test")),
            ),
            lambda x: x["test"].isNotNull(),
        ),
    ).drop("_found", "_runs")


def rejection_bounds(found: DataFrame, alpha: float = ALPHA) -> dict[tuple[str, int], float]:
    """log10 p at or under which a candidate is taken as not random, by encoding and length band."""
    tests = found.select(F.explode("_tokens.test").alias("t")).select(
        F.col("t.encoding").alias("encoding"), _band(F.col("t.size")).alias("band"),
        F.greatest(F.ceil(F.col("t.logp") * 100), F.lit(-BINS)).cast("int").alias("bin"),
    )
    counts = tests.groupBy("encoding", "band", "bin").count()
    # At most 3 x 4 x BINS rows: small enough for one task whatever the corpus.
    table: dict[tuple[str, int], list[tuple[int, int]]] = {}
    for encoding, band, bin_, count in counts.orderBy("encoding", "band", "bin").toLocalIterator():
        table.setdefault((encoding, band), []).append((bin_, count))
    bounds = {}
    for key, bins in table.items():
        total, below, bound = sum(c for _, c in bins), 0, float("-inf")
        for bin_, count in bins:
            below += count
            if 10 ** (bin_ / 100) <= alpha * below / total:
                bound = bin_ / 100
        bounds[key] = bound
    return bounds


def _random_spans(bounds: dict[tuple[str, int], float]) -> Column:
    def secret(x: Column) -> Column:
        bound = F.lit(float("-inf"))
        for (encoding, band), value in bounds.items():
            bound = F.when((x["test"]["encoding"] == encoding) & (_band(x["test"]["size"]) == band), F.lit(value)).otherwise(bound)
        return F.ceil(x["test"]["logp"] * 100) / 100 > bound

    return F.transform(
        F.filter("_tokens", secret),
        lambda x: F.struct(x["start"].alias("start"), F.lit(3).alias("kind"), x["end"].alias("end")),
    )


def secret_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", alpha: float = ALPHA) -> DataFrame:
    """(id, base, spans) per row: sorted arrays of struct<start, kind, end>; kind indexes KINDS."""
    own = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    found = staged(scanned(own).drop("text"), "secrets")
    extra = _random_spans(rejection_bounds(found, alpha))
    return found.select(F.col("id").alias(id_col), F.col("_base").alias("base"), F.array_sort(F.concat("_base", extra)).alias("spans"))


def redact_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """All rows and columns of ``docs``; every secret in ``text_col`` gives way to ``mark``.

    Texts without a secret, null among them, stay as they are. Other columns pass in one struct, so
    none of them can clash with a name used here.
    """
    others = [F.col(f"`{c}`") for c in docs.columns if c != text_col] or [F.lit(True).alias("alone")]
    own = docs.select(F.struct(*others).alias("row"), F.col(text_col).cast("string").alias("text"))
    found = staged(scanned(own), "secret-tests")
    extra = _random_spans(rejection_bounds(found))
    spans = F.array_sort(F.concat("_base", extra))
    cleaned = F.when(F.size("spans") > 0, _redacted(F.col("text"), F.col("spans"), mark)).otherwise(F.col("text"))
    found = found.select("row", "text", spans.alias("spans")).select("row", cleaned.alias("cleaned"))
    return found.select(*[(F.col("cleaned") if c == text_col else F.col("row").getField(c)).alias(c) for c in docs.columns])


def _redacted(text: Column, spans: Column, mark: str) -> Column:
    """``text`` with every union of overlapping sorted spans as one ``mark``, a piece of spans at a time."""
    def ahead(acc: Column, part: Column) -> Column:
        ends = F.greatest(acc["at"], F.array_max(F.transform(part, lambda x: x["end"])))
        return F.struct(ends.alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out"))

    def cleaned(part: Column, at: Column) -> Column:
        # What lies between the ends of the spans before this piece and the start of its last span.
        inner = F.substring(text, (at + 1).cast("int"), (F.element_at(part, -1)["start"] - at).cast("int"))

        def step(acc: Column, x: Column, inner: Column) -> Column:
            kept = F.substring(inner, (acc["at"] - at + 1).cast("int"), (x["start"] - acc["at"]).cast("int"))
            return F.struct(
                F.greatest(acc["at"], x["end"]).alias("at"),
                F.when(x["start"] >= acc["at"], F.concat(acc["out"], kept, F.lit(mark))).otherwise(acc["out"]).alias("out"),
            )

        return _let(inner, lambda i: F.aggregate(
            part, F.struct(at.alias("at"), F.lit("").alias("out")), lambda acc, x: step(acc, x, i), lambda acc: acc["out"]
        ))

    def joined(parts: Column) -> Column:
        starts = F.aggregate(
            parts, F.struct(F.lit(0).cast("long").alias("at"), _empty("bigint").alias("out")), ahead, lambda acc: acc["out"]
        )
        last = F.array_max(F.transform(spans, lambda x: x["end"]))
        rest = F.substring(text, (last + 1).cast("int"), F.length(text))
        return F.concat(F.array_join(F.zip_with(parts, starts, cleaned), ""), rest)

    return _let(_pieces(spans, lambda part: part), joined)
