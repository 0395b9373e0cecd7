"""Languages of web pages by Bayesian evidence fusion.

Method. Four kinds of evidence are combined as independent given the language:
* the text's likelihood, from byte trigrams of the visible text (markup, scripts, styles and comments
  left out), under counts over all documents with a known language;
* the language that the markup declares: that of the html tag, else of a content-language meta tag;
* the address suffix: top-level domain, and a language directory at the head of the path;
* the host's prior, smoothed hierarchically: host towards registered domain towards all pages.

The last three are learned from all pages by grouped aggregation of the text's own posteriors; each page's
own share is taken out again before its language is judged, so no page confirms itself. Neighbouring
trigrams are not independent, so the likelihood counts as that of at most `weight` of them.

Defined results
* null, empty or wordless html: no text evidence; the other evidence decides.
* null or unusable url: no host and no suffix, each a group of its own like any other.
* null ids and repeated rows: each row is reported. A declared language outside the known ones is `other`.
* Ties go to the language that is first in alphabetical order. An empty table gives an empty result.
* Without any document of a known language: an error. Other columns are not read.
* Whole pages count, whatever their length.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wareflow.llm.rows import map_texts, pieces, texts_of
from wareflow.llm.store import Scratch
from wareflow.llm.words import LETTERS

#: Buckets of trigrams; languages; groups of a kind of evidence that are sent to every task (more are joined).
BUCKETS, MOST_LANGUAGES, MOST_SENT = 1 << 15, 256, 100_000

_HIDDEN = re.compile(rb"(?is)<!--.*?-->|<(script|style)\b.*?</\1\s*>|<[^>]*>|&#?\w{1,12};")
_DECLARED = re.compile(rb"(?is)<html\b[^>]*?\blang\s*=\s*[\"']?\s*([a-z]{2,3})(?=[\s\"'>_-])")
_META = re.compile(rb"(?is)<meta\b(?=[^>]*?\bhttp-equiv\s*=\s*[\"']?\s*content-language\b)[^>]*?\bcontent\s*=\s*[\"']?\s*([a-z]{2,3})(?=[\s\"'>_,;/-])")
_ADDRESS = re.compile(r"(?i)^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)(?::\d+)?(?:/([a-z]{2,3})(?=[/?#]|$))?")

#: Second labels under which countries register names, and other suffixes of two labels.
_SECOND = frozenset("ac co com edu gob gouv gov gub ltd mil ne net nom or org plc sch".split())
_SUFFIXES = frozenset(
    "github.io gitlab.io blogspot.com wordpress.com tumblr.com herokuapp.com netlify.app vercel.app pages.dev web.app firebaseapp.com azurewebsites.net"
    " appspot.com readthedocs.io weebly.com wixsite.com livejournal.com substack.com neocities.org altervista.org go.jp gr.jp lg.jp ad.jp"
    " go.kr re.kr pe.kr go.th in.th go.id my.id web.id me.uk nhs.uk police.uk id.au asn.au geek.nz maori.nz govt.nz gen.in firm.in ind.in"
    " gov.in nic.in res.in web.za law.za gen.tr web.tr info.tr bel.tr k12.tr org.il muni.il idf.il k12.il art.br blog.br eco.br eng.br ind.br"
    " inf.br jus.br leg.br tv.br asso.fr tm.fr gv.at priv.at waw.pl info.pl edu.pl in.ua kiev.ua lviv.ua msk.ru spb.ru uk.com us.com eu.com de.com".split()
)
_IP = re.compile(r"[0-9.]+|\[.*")

_LETTER = np.where(LETTERS, np.arange(256), 0x20).astype(np.uint8)


def visible(html: bytes) -> bytes:
    """The text of a page outside its markup."""
    return _HIDDEN.sub(b" ", html)


def declared(html: bytes) -> str | None:
    """The primary language that the markup declares."""
    found = _DECLARED.search(html) or _META.search(html)
    return found[1].decode().lower() if found else None


def registered(host: str) -> str:
    """The registered domain: two labels, or three where the last two are a common suffix; an address of numbers is its own."""
    labels = host.split(".")
    if _IP.fullmatch(host):
        return host
    two = ".".join(labels[-2:])
    shared = two in _SUFFIXES or (len(labels) > 2 and len(labels[-1]) == 2 and labels[-2] in _SECOND)
    return ".".join(labels[-3:]) if shared else two


def address(url: str | None) -> tuple[str, str, str]:
    """Host, registered domain and suffix of an address; empty if it has none."""
    found = _ADDRESS.match(url or "")
    if not found:
        return "", "", ""
    host = found[1].lower().strip(".")
    labels = host.split(".")
    return host, registered(host), f"{labels[-1][:24]}/{(found[2] or '').lower()}"


def trigrams(text: bytes) -> np.ndarray:
    """Buckets of the trigrams of lower-cased letters; runs of anything else are one blank."""
    data = _LETTER[np.frombuffer(b" " + text.lower() + b" ", np.uint8)]
    blank = data == 0x20
    data = data[~(blank & np.concatenate(([False], blank[:-1])))].astype(np.uint32)
    if len(data) < 3:
        return np.empty(0, np.int64)
    value = (data[:-2] << np.uint32(16)) | (data[1:-1] << np.uint32(8)) | data[2:]
    return ((value * np.uint32(0x9E3779B1)) >> np.uint32(32 - 15)).astype(np.int64)


class Likelihood:
    """Log probabilities of trigram buckets in each language."""

    def __init__(self, names: list[str], counts: np.ndarray, smoothing: float = 0.5):
        self.names = names
        self.logs = np.log((counts + smoothing) / (counts.sum(axis=1, keepdims=True) + smoothing * BUCKETS)).T.copy()

    def evidence(self, text: bytes, weight: int) -> np.ndarray:
        """Log likelihood of a text in each language, as that of at most `weight` trigrams."""
        found = trigrams(text)
        if not len(found):
            return np.zeros(len(self.names))
        total = self.logs[found].sum(axis=0) if len(found) < BUCKETS else np.bincount(found, minlength=BUCKETS) @ self.logs
        return total * min(1.0, weight / len(found))


def train(docs: DataFrame, text: str = "text", lang: str = "lang") -> Likelihood:
    """Trigram counts over all documents whose language is known."""
    known = docs.where(F.col(lang).isNotNull()).select(F.col(lang).alias("lang"), F.col(text).alias("text"))
    names = sorted(r["lang"] for r in known.select("lang").distinct().limit(MOST_LANGUAGES + 1).collect())
    if not 0 < len(names) <= MOST_LANGUAGES:
        raise ValueError(f"there must be 1 to {MOST_LANGUAGES} languages to learn")
    number = {name: k for k, name in enumerate(names)}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(names), BUCKETS), np.int64)
        for batch in batches:
            for part in pieces(batch, "text"):
                for name, t in zip(part.column("lang").to_pylist(), texts_of(part.column("text"))):
                    total[number[name]] += np.bincount(trigrams(t), minlength=BUCKETS)
        row, bucket = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(row.astype(np.int32)), pa.array(bucket.astype(np.int32)), pa.array(total[row, bucket])], names=["row", "bucket", "n"])

    counts = np.zeros((len(names), BUCKETS))
    sums = known.mapInArrow(count, "row int, bucket int, n long").groupBy("row", "bucket").agg(F.sum("n").alias("n"))
    for r in sums.collect():
        counts[r["row"], r["bucket"]] = r["n"]
    return Likelihood(names, counts)


def _posterior(evidence: np.ndarray) -> np.ndarray:
    p = np.exp(evidence - evidence.max(axis=-1, keepdims=True))
    return p / p.sum(axis=-1, keepdims=True)


def page_evidence(pages: DataFrame, model: Likelihood, weight: int) -> DataFrame:
    """page_id, host, domain, suffix, declared, and the text's evidence and posterior of each page."""
    kind = pages.schema["page_id"].dataType.simpleString()
    sent = pages.sparkSession.sparkContext.broadcast(model)

    def read(part: pa.RecordBatch) -> dict:
        html = texts_of(part.column("html"))
        model = sent.value
        evidence = np.stack([model.evidence(visible(h), weight) for h in html]) if html else np.empty((0, len(model.names)))
        said = [declared(h) for h in html]
        hosts, domains, suffixes = zip(*map(address, part.column("url").to_pylist())) if html else ((), (), ())
        return {
            "page_id": part.column("page_id"),
            "host": hosts,
            "domain": domains,
            "suffix": suffixes,
            "declared": [d if d is None or d in model.names else "other" for d in said],
            "evidence": list(evidence),
            "posterior": list(_posterior(evidence)) if html else [],
        }

    schema = f"page_id {kind}, host string, domain string, suffix string, declared string, evidence array<double>, posterior array<double>"
    return map_texts(pages.select("page_id", "url", "html"), "html", read, schema)


def _soft_counts(rows: DataFrame, key: str, size: int) -> DataFrame:
    """(key, n_key): sums of the posteriors of each group of pages."""
    return rows.groupBy(key).agg(F.array(*(F.sum(F.col("posterior")[k]) for k in range(size))).alias(f"n_{key}"))


def _with_counts(rows: DataFrame, counts: DataFrame, key: str, scratch: Scratch) -> DataFrame:
    counts = scratch.keep(counts, key)
    if counts.count() <= MOST_SENT:
        counts = F.broadcast(counts)
    counts = counts.withColumnRenamed(key, "key_")
    return rows.join(counts, rows[key].eqNullSafe(counts["key_"])).drop("key_")


def fused(evidence: np.ndarray, own: np.ndarray, everything: np.ndarray, host: np.ndarray, domain: np.ndarray, groups: list[tuple[np.ndarray, int]], strength: float) -> np.ndarray:
    """Posteriors of pages; all counts still hold the pages' own shares `own`.

    groups: for each further kind of evidence, the counts of the page's group and how many groups
    there are.
    """
    size = own.shape[1]
    rest = np.maximum(everything - own, 0)
    base = (rest + 1.0 / size) / (rest.sum(axis=1, keepdims=True) + 1.0)

    def towards(counts: np.ndarray, prior: np.ndarray) -> np.ndarray:
        others = np.maximum(counts - own, 0)
        return (others + strength * prior) / (others.sum(axis=1, keepdims=True) + strength)

    total = evidence + np.log(towards(host, towards(domain, base)))
    for counts, kinds in groups:
        # P(group | language), smoothed towards the group's share of all pages.
        others = np.maximum(counts - own, 0)
        share = (others.sum(axis=1, keepdims=True) + 1.0) / (rest.sum(axis=1, keepdims=True) + kinds)
        total = total + np.log((others + strength * share) / (rest + strength))
    return _posterior(total)


def identify(pages: DataFrame, model: Likelihood, scratch: Scratch, weight: int = 60, strength: float = 5.0) -> DataFrame:
    """page_id, lang, confidence, text_lang, text_confidence, declared, host of every page."""
    size = len(model.names)
    rows = scratch.keep(page_evidence(pages, model, weight), "evidence")
    everything = rows.agg(F.count("*").alias("n"), *(F.sum(F.col("posterior")[k]).alias(f"s{k}") for k in range(size))).first()
    total = np.array([everything[f"s{k}"] or 0.0 for k in range(size)])
    out = rows
    kinds = {}
    for key in ("host", "domain", "suffix", "declared"):
        counts = _soft_counts(rows, key, size)
        out = _with_counts(out, counts, key, scratch)
        kinds[key] = rows.select(key).distinct().count() if key in ("suffix", "declared") else 0
    kind = rows.schema["page_id"].dataType.simpleString()
    names = np.array(model.names)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            matrix = lambda c: batch.column(c).flatten().to_numpy(zero_copy_only=False).reshape(-1, size)  # noqa: E731, B023
            own = matrix("posterior")
            p = fused(matrix("evidence"), own, total, matrix("n_host"), matrix("n_domain"), [(matrix(f"n_{k}"), kinds[k]) for k in ("suffix", "declared")], strength)
            best, text = p.argmax(axis=1), own.argmax(axis=1)
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), pa.array(names[best]), pa.array(p.max(axis=1)), pa.array(names[text]), pa.array(own.max(axis=1)), batch.column("declared"), batch.column("host")],
                names=["page_id", "lang", "confidence", "text_lang", "text_confidence", "declared", "host"],
            )

    return out.mapInArrow(judge, f"page_id {kind}, lang string, confidence double, text_lang string, text_confidence double, declared string, host string")
