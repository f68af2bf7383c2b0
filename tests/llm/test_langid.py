"""Language evidence against a plain loop, and accuracy on pages whose address names the language."""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict

import pyarrow as pa

from corpusaudit.llm import langid as L
from corpusaudit.llm.queries import QUERIES


def brute(pages, names, logs):
    rows = []
    for key, url, html in pages:
        m = re.match(r"[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", url or "")
        host = m[1].lower() if m else ""
        d = re.search(L.DECLARED, html or "")
        text = re.sub(L.TAGS, " ", html or "")
        bucket, _ = L.trigrams(pa.array([text]))
        ll = logs[:, bucket].sum(1) if len(bucket) else [0.0] * len(names)
        dom = re.search(r"([^.]*\.[^.]*)$", host)
        suf = re.search(r"\.([^.]*)$", host)
        rows.append((key, host, dom[1] if dom else "", suf[1] if suf else "", d[1].lower() if d else "", list(ll), len(bucket)))
    k = range(len(names))
    count = {c: defaultdict(Counter) for c in ("host", "dom", "suf", "dec")}
    total = Counter()
    for _, host, dom, suf, dec, ll, n in rows:
        for c, v in (("host", host), ("dom", dom), ("suf", suf), ("dec", dec)):
            count[c][v]
        if n >= L.ENOUGH:
            top = max(k, key=lambda i: (ll[i], -i))
            total[top] += 1
            for c, v in (("host", host), ("dom", dom), ("suf", suf), ("dec", dec)):
                count[c][v][top] += 1
    prior = [(total[i] + 1) / (sum(total.values()) + len(names)) for i in k]
    out = {}
    for key, host, dom, suf, dec, ll, n in rows:
        d = [(count["dom"][dom][i] + L.WEIGHT * prior[i]) / (sum(count["dom"][dom].values()) + L.WEIGHT) for i in k]
        h = [(count["host"][host][i] + L.WEIGHT * d[i]) / (sum(count["host"][host].values()) + L.WEIGHT) for i in k]
        p = [ll[i] / L.TEMPER + math.log(h[i])
             + (math.log((count["dec"][dec][i] + 1) / (total[i] + len(count["dec"]))) if dec else 0)
             + (math.log((count["suf"][suf][i] + 1) / (total[i] + len(count["suf"]))) if suf else 0) for i in k]
        best = max(k, key=lambda i: (p[i], -i))
        out[key] = names[best], 1 / sum(math.exp(x - p[best]) for x in p), dec, host
    return out


def test_whole_table(spark, sf_dir):
    pages = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html").collect()]
    names, logs = L.language_model(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    want = brute(pages, names, logs)
    got = {r.page_id: r for r in QUERIES["op4_language_fusion"](spark, sf_dir).collect()}
    assert got.keys() == want.keys()
    for key, (lang, confidence, declared, host) in want.items():
        assert (got[key].lang, got[key].declared, got[key].host) == (lang, declared, host) and abs(got[key].confidence - confidence) < 1e-5
    truth = {k: re.search(r"//[^/]*/([a-z]+)/", u)[1] for k, u, _ in pages if re.search(r"//[^/]*/([a-z]+)/", u)}
    assert sum(got[k].lang == v for k, v in truth.items()) >= 0.97 * len(truth)


def test_evidence_decides_where_text_is_silent(spark):
    docs = spark.createDataFrame([("the cat and the dog " * 20, "en"), ("der hund und die katze " * 20, "de"), (None, "en"), ("x", None)], "text string, lang string")
    pages = [(i, f"http://a.example.de/{i}", '<html lang="de"><p>der hund und die katze und der hund</p>') for i in range(20)]
    pages += [(100 + i, f"http://b.example.uk/{i}", "<html lang=en><p>the cat and the dog and the cat</p>") for i in range(20)]
    pages += [(200, "http://a.example.de/x", None), (201, "http://b.example.uk/x", ""), (202, None, '<html lang="de"></html>'), (203, None, None), (203, "", "<script>the cat</script>")]
    df = spark.createDataFrame([(k, u, h, "c") for k, u, h in pages], "page_id long, url string, html string, lang string")
    got = {r.page_id: r.lang for r in L.identify(df, docs).collect()}
    assert (got[200], got[201], got[202]) == ("de", "en", "de") and got[0] == "de" and got[100] == "en"
    assert L.identify(df, docs).count() == len(pages)
    assert L.identify(df.limit(0), docs).count() == 0
    assert {r.lang for r in L.identify(df, docs.limit(0)).collect()} == {None}
