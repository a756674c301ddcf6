"""Personal information inside free text: found, and replaced by typed placeholders, after the information theory of disclosure.

Forms (pii_patterns) only propose candidates; none of them decides. Terms of a candidate are looked up in statistics of the whole corpus: how strongly
does a term reveal a protected entity? The measure is disclosure in bits, log2 of the share of the term's occurrences that stand beside what is
protected: 0 bits is full disclosure, -1 bit means that every second occurrence does.

1. One pass over all texts gives candidates of every kind with their terms, the counts of all words, and what kinds of numbers follow which word.
2. Terms of e-mail addresses, phones, identity numbers and addresses are their form, the word before them (cue), and their own digits. A form that tells by
   itself discloses by the share of its occurrences not beside a label of things (ISBN, invoice, build ...); an open form ("9876543210", "via Porta 80") by
   the share beside a label of its kind. A cue discloses phones by the share of self-telling phones among the numbers that follow it in the
   corpus; digits disclose by the share of their occurrences beside a label. Labels of the kind disclose fully, labels of things not at all.
3. Terms of a name are its parts. A family part discloses by the share of its occurrences that follow a known given part; a given part by the share that
   precedes a family part found so; a second round counts the given parts learned. Parts in the lexicon (which is incomplete, and whose given
   parts are partly everyday words) disclose by being there, but a pair still needs both of its parts.
4. A candidate whose strongest term exceeds the threshold of its kind (both parts, for names) is generalised to its placeholder; an overlap goes to the
   stronger kind of evidence, the longer span, the earlier one.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronoweave.llm import pii_patterns as patterns
from chronoweave.session import written

KINDS = {"email": "[EMAIL]", "phone": "[PHONE]", "id_number": "[ID_NUMBER]", "address": "[ADDRESS]", "name": "[NAME]"}
LEAST_BITS = -1.0  # a term of a number, address or e-mail must be revealing in half of its occurrences
LEAST_CUE_BITS = -0.15  # a word before numbers in nine of ten
LEAST_NAME_BITS = -2.0  # a part of a name in a quarter
LEAST_CUES = 20  # numbers that a cue must stand before to be judged
PRIOR = 50  # occurrences that the prior of a form counts for, SURE of them revealing for a form that tells by itself, none for an open one
SURE = 49
MOST_LEXICON = 100_000
MOST_WORDS = 200_000
_SCAN = pa.schema([("k1", pa.int64()), ("k2", pa.int64()), ("doc_id", pa.int64()), ("start_pos", pa.int32()), ("end_pos", pa.int32()), ("kind", pa.string()), ("a", pa.string()), ("b", pa.string()), ("a_known", pa.bool_()), ("b_known", pa.bool_()), ("told", pa.int32()), ("n", pa.int64())])
_SCAN_DDL = "k1 long, k2 long, doc_id long, start_pos int, end_pos int, kind string, a string, b string, a_known boolean, b_known boolean, told int, n long"
_ID = ["k1", "k2", "doc_id"]


def _free(spans: list[tuple], start: int, end: int) -> bool:
    return not any(s[0] < end and start < s[1] for s in spans)


def find_direct(text: str) -> list[patterns.Candidate]:
    """Candidates of all kinds but names, without overlaps between kinds, and numbers of no form (kind number); positions from 0, in code points."""
    out = list(patterns.emails(text))
    for group in (patterns.numbers, patterns.addresses):
        for c in group(text):
            if _free(out, c.start, c.end):
                out.append(c)
            elif c.kind == "address" and c.sure:  # an address covers the open numbers in it
                over = [x for x in out if x.start < c.end and c.start < x.end]
                if all(not x.sure and x.told < 1 for x in over):
                    out = [x for x in out if x not in over] + [c]
    return out


def _scan(lexicon) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lex = patterns.Lexicon(*lexicon.value)
        counts: Counter[tuple[str, str]] = Counter()
        words: Counter[str] = Counter()
        none = (None,) * 3

        def told(rows: list[tuple]) -> pa.RecordBatch:
            return pa.record_batch([pa.array(c, t.type) for c, t in zip(zip(*rows), _SCAN)], schema=_SCAN)

        def counted() -> pa.RecordBatch:
            rows = [(*none, None, None, "word", w, None, None, None, None, n) for w, n in words.items()]
            rows += [(*none, None, None, "cue", a, b, None, None, None, n) for (a, b), n in counts.items()]
            words.clear()
            counts.clear()
            return told(rows)

        for batch in batches:
            rows: list[tuple] = []
            for *key, x in zip(*(batch.column(i).to_pylist() for i in range(3)), batch.column(3)):
                text = x.as_py()
                if not text:
                    continue
                found = patterns.words(text)
                words.update(map(str.lower, found))
                direct = find_direct(text)
                for c in direct:
                    if c.cue and c.kind in ("phone", "id_number", "number"):
                        counts[c.cue, "phone" if c.kind == "phone" and c.sure and c.told >= 0 else "number"] += 1
                    if c.kind != "number":
                        value = "".join(filter(str.isdigit, text[c.start : c.end])) if c.kind in ("phone", "id_number") else ""
                        rows.append((*key, c.start, c.end, c.kind, f"{c.kind} {c.form}", f"{value} {c.cue or ''}", c.sure, None, c.told, None))
                mails = [(c.start, c.end) for c in direct if c.kind == "email"]
                fixed = [c for c in direct if c.sure or c.told > 0]
                for a, b, given, family, form in dict.fromkeys(patterns.names(text, set(found), lex, mails)):
                    if _free(fixed, a, b):
                        rows.append((*key, a, b, form, given, family, given in lex.given, family in lex.family, None, None))
            if rows:
                yield told(rows)
            if len(words) + len(counts) > MOST_WORDS:
                yield counted()
        if words or counts:
            yield counted()

    return run


def _keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text and two hashes of both, which name a row's content whether its id is null or repeated."""
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return d.withColumns({"k1": F.xxhash64(F.coalesce("doc_id", F.lit(0)), F.col("doc_id").isNull(), "text"), "k2": F.xxhash64("text", F.lit(1), F.coalesce("doc_id", F.lit(-1)))})


def scan(docs: DataFrame, lexicon: DataFrame) -> DataFrame:
    """Candidates, word counts (kind word) and counts of numbers after cues (kind cue), in one pass over the texts.

    The lexicon (part_text, part_kind) is sent to every executor and may have 100,000 rows at most, else an error.
    """
    known = lexicon.filter("part_text is not null").select("part_text", "part_kind").limit(MOST_LEXICON + 1).collect()
    if len(known) > MOST_LEXICON:
        raise ValueError("the lexicon has more than 100,000 parts")
    parts = [[r.part_text for r in known if r.part_kind == kind] for kind in ("given", "family")]
    sent = docs.sparkSession.sparkContext.broadcast(parts)
    return _keyed(docs).select(*_ID, "text").mapInArrow(_scan(sent), _SCAN_DDL)


def bits(share: Column) -> Column:
    """Disclosure in bits of a share of revealing occurrences; 0 is full disclosure."""
    return F.log2(share)


def disclosed(scanned: DataFrame, least: float = LEAST_BITS, least_cue: float = LEAST_CUE_BITS) -> DataFrame:
    """The candidates of scanned that are no names and whose strongest term discloses: k1, k2, doc_id, start_pos, end_pos, kind, bits.

    Forms are a few dozen, so their statistics are broadcast; cues and digits are looked up for candidates of open forms only.
    """
    c = scanned.filter(F.col("kind").isin(*KINDS)).select(*_ID, "start_pos", "end_pos", "kind", F.col("a").alias("form"), F.col("b").alias("term"), F.col("a_known").alias("sure"), "told")
    per_form = c.groupBy("form", "sure").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("told") > 0).alias("n_label"), F.count_if(F.col("told") < 0).alias("n_thing"))
    of_form = per_form.select("form", bits(F.when(F.col("sure"), (F.col("n") - F.col("n_thing") + SURE) / (F.col("n") + PRIOR)).otherwise(F.greatest(F.col("n_label"), F.lit(0.01)) / (F.col("n") + PRIOR))).alias("_form"))
    scored = c.join(F.broadcast(of_form), "form")
    closed = scored.filter("sure or told <> 0").select(*_ID, "start_pos", "end_pos", "kind", F.when(F.col("told") > 0, F.lit(0.0)).when(F.col("told") < 0, F.lit(-math.inf)).otherwise(F.col("_form")).alias("bits"))
    numbers = scored.filter("not sure and told = 0").withColumns({"value": F.split_part("term", F.lit(" "), F.lit(1)), "cue": F.split_part("term", F.lit(" "), F.lit(2))})
    cues = scanned.filter("kind = 'cue'").groupBy(F.col("a").alias("cue")).agg(F.sum("n").alias("_all"), F.sum(F.when(F.col("b") == "phone", F.col("n")).otherwise(0)).alias("_phones"))
    of_cue = cues.filter(F.col("_all") >= LEAST_CUES).select("cue", bits(F.col("_phones") / F.col("_all")).alias("_cue")).filter(F.col("_cue") >= least_cue)
    with_digits = c.filter("kind in ('phone', 'id_number')").select("kind", F.split_part("term", F.lit(" "), F.lit(1)).alias("value"), "told")
    of_value = with_digits.groupBy("kind", "value").agg(F.count_if(F.col("told") > 0).alias("_l"), F.count(F.lit(1)).alias("_n")).filter("_l > 0").select("kind", "value", bits(F.col("_l") / F.col("_n")).alias("_value")).filter(F.col("_value") >= least)
    looked = numbers.join(of_cue, "cue", "left").join(of_value, ["kind", "value"], "left")
    none = F.lit(-math.inf)
    strongest = F.greatest("_form", F.coalesce(F.when(F.col("kind") == "phone", F.col("_cue")), none), F.coalesce("_value", none))
    opened = looked.select(*_ID, "start_pos", "end_pos", "kind", strongest.alias("bits"))
    return closed.unionByName(opened).filter(F.col("bits") >= least)


def term_disclosure(scanned: DataFrame, least: float = LEAST_NAME_BITS) -> tuple[DataFrame, DataFrame]:
    """How strongly family parts (b, bits) and given parts (a, bits) disclose a person; only those of at least `least` bits.

    Pairs of parts are counted and meet the counts of their words once, in a table of which every round is one aggregation and one join.
    """
    totals = scanned.filter("kind = 'word'").groupBy(F.col("a").alias("w")).agg(F.sum("n").alias("total"))
    pairs = scanned.filter("kind in ('forward', 'back')").groupBy("a", "b", "a_known", "b_known").agg(F.count(F.lit(1)).alias("n"))
    of = lambda c: totals.select(F.col("w").alias(c), F.col("total").alias(f"{c}_total"))
    pairs = written(pairs.join(of("a"), "a", "left").join(of("b"), "b", "left"), "pii-pairs")

    def scored(beside: DataFrame, part: str) -> DataFrame:
        per = beside.groupBy(part).agg(F.sum("n").alias("_n"), F.max(f"{part}_known").alias("_known"), F.coalesce(F.max(f"{part}_total"), F.lit(0)).alias("_t"))
        share = F.when(F.col("_known"), 1.0).otherwise(F.col("_n") / F.greatest("_n", "_t"))
        return per.select(part, bits(share).alias("bits")).filter(F.col("bits") >= least)

    def families(given: DataFrame | None) -> DataFrame:
        known = F.col("a_known") | F.col("b_known")
        beside = pairs.filter(known) if given is None else pairs.join(given.select("a", F.lit(True).alias("_g")), "a", "left").filter(known | F.col("_g"))
        return scored(beside, "b")

    def givens(family: DataFrame) -> DataFrame:
        return scored(pairs.filter("length(a) > 2 or a not like '%.'").join(family.select("b"), "b", "left_semi"), "a")

    family = written(families(givens(families(None))), "pii-families")
    return family, written(givens(family), "pii-givens")


def _resolve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per document: direct kinds before names, names in natural order before turned ones that overlap them, longer spans before shorter ones."""
    span = pa.list_(pa.struct([("start_pos", pa.int32()), ("end_pos", pa.int32()), ("kind", pa.string())]))
    for batch in batches:
        out = []
        for spans in batch.column(3).to_pylist():
            kept: list[tuple[int, int, str]] = []
            for s in sorted(spans, key=lambda s: (s["kind"] == "back", s["kind"] == "forward", s["start_pos"] - s["end_pos"], s["start_pos"])):
                if _free(kept, s["start_pos"], s["end_pos"]):
                    kept.append((s["start_pos"], s["end_pos"], "name" if s["kind"] in ("forward", "back") else s["kind"]))
            out.append([{"start_pos": a, "end_pos": b, "kind": k} for a, b, k in sorted(kept)])
        yield pa.record_batch([*batch.columns[:3], pa.array(out, span)], names=[*_ID, "spans"])


def find_spans(docs: DataFrame, lexicon: DataFrame, least: float = LEAST_BITS, least_name: float = LEAST_NAME_BITS) -> DataFrame:
    """k1, k2, doc_id and spans (array of start_pos and end_pos from 0, end exclusive, in code points, and kind) of the documents with finds.

    k1 and k2 name a document by its id and text: rows with a null id are documents too, rows of one id and different texts several, rows
    alike in both are one. Null and empty texts have no finds. Whole texts are searched. Extra columns are ignored. An empty lexicon leaves
    the kinds without names. Empty input gives no rows.
    """
    scanned = written(scan(docs, lexicon), "pii-scan")
    family, given = term_disclosure(scanned, least_name)
    named = scanned.filter("kind in ('forward', 'back')").join(family.select("b"), "b", "left_semi").join(given.select("a", F.lit(True).alias("_given")), "a", "left")
    named = named.filter("_given or (length(a) = 2 and a like '%.')")
    columns = [*_ID, "start_pos", "end_pos", "kind"]
    spans = disclosed(scanned, least).select(*columns).unionByName(named.select(*columns))
    per_doc = spans.groupBy(*_ID).agg(F.collect_set(F.struct("start_pos", "end_pos", "kind")).alias("spans"))
    return per_doc.mapInArrow(_resolve, "k1 long, k2 long, doc_id long, spans array<struct<start_pos: int, end_pos: int, kind: string>>")


def found(docs: DataFrame, lexicon: DataFrame) -> DataFrame:
    """One row per occurrence: doc_id, start_pos (from 1, in code points), kind. A document without id gives rows with a null id."""
    return find_spans(docs, lexicon).select("doc_id", F.explode("spans").alias("s")).select("doc_id", (F.col("s.start_pos") + 1).cast("long").alias("start_pos"), F.col("s.kind").alias("kind"))


def _replace(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = []
        for x, spans in zip(batch.column("text"), batch.column("spans").to_pylist()):
            text = x.as_py()
            if text and spans:
                out, at = [], 0
                for s in spans:
                    out += [text[at : s["start_pos"]], KINDS[s["kind"]]]
                    at = s["end_pos"]
                text = "".join([*out, text[at:]])
            texts.append(text)
        yield pa.record_batch([batch.column("doc_id"), pa.array(texts, pa.string()), pa.array([len(s or []) for s in batch.column("spans").to_pylist()], pa.int32())], names=["doc_id", "text", "n_found"])


def sanitise(docs: DataFrame, lexicon: DataFrame) -> DataFrame:
    """doc_id, text with each find replaced by its placeholder and the rest unchanged, n_found.

    Every row comes out, those with null or repeated ids cleaned by their own text's finds too; null texts stay null.
    """
    spans = find_spans(docs, lexicon).select("k1", "k2", "spans")
    return _keyed(docs).join(spans, ["k1", "k2"], "left").select("doc_id", "text", "spans").mapInArrow(_replace, "doc_id long, text string, n_found int")
