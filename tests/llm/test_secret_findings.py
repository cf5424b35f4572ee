"""Findings against a scan character by character, and a forest that does more than its labelling rules."""

import random
import re

from pyspark.sql import functions as F

from lakeops.llm import secret_scan

TOKEN = set("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-")
NAME = re.compile(r"(?:[Pp]ass(?:word|wd)?|PASS(?:WORD|WD)?|[Pp]wd|PWD|[Ss]ecret|SECRET|[Tt]oken|TOKEN|[Kk]ey|KEY)[\"']?\s{0,2}[:=]\s{0,2}[\"']?\Z")
STOP = set(" \t\n\x0b\f\r\"',;<>")


def naive(text):
    out, at = [], 0
    while at < len(text):
        end = at
        if at and text[at] not in STOP and NAME.search(text[max(0, at - 30):at]):
            while end < len(text) and text[end] not in STOP:
                end += 1
        if end - at < 6:
            end = at
            if at == 0 or text[at - 1] not in TOKEN:
                while end < len(text) and text[end] in TOKEN:
                    end += 1
            if end - at < 16 or not any(c.isdigit() for c in text[at:end]):
                end = at
        if end > at:
            out.append((at, end, text[at:end]))
        at = max(end, at + 1)
    return out


def test_findings_equal_a_naive_scan(spark):
    rng = random.Random(4)
    bits = ["password", "Token", "KEY", "secret", " = ", "=", ": ", ":", '"', "'", " ", "\n", "hunter2!", "a1b2c3d4e5f6a7b8", "é", "word",
            "0123456789abcdef0123", "aaaaaaaaaaaaaaaaaaaa", ",", "x_y-z/9+", "<", "Abc.def", "pass", "9"]
    rows = [(i, "".join(rng.choice(bits) for _ in range(rng.randint(0, 25))), "src") for i in range(1500)]
    rows += [(9001, None, "src"), (9002, "", None), (None, "token=abc123!x", "src"), (9003, "k" * 100_000 + "1", "src")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    got = sorted(((r.doc_id, r.start, r.end, r.finding) for r in secret_scan.findings(docs).collect()), key=repr)
    want = sorted(((i, *f) for i, t, _ in rows for f in naive(t or "")), key=repr)
    assert got == want and len(want) > 800


def test_the_forest_goes_beyond_its_rules(spark):
    """Planted secrets outside assignments, of which no rule says anything, are told from harmless numbers and names."""
    rng = random.Random(7)
    hexa = lambda n: "".join(rng.choice("0123456789abcdef") for _ in range(n))
    mixed = lambda n: "".join(rng.choice("ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz23456789") for _ in range(n))
    prose = lambda n: " ".join(rng.choice(["river", "stone", "window", "garden", "letter", "summer"]) for _ in range(n))
    rows, truth = [], {}
    for i in range(900):
        kind = rng.randrange(6)
        s = [hexa(40), mixed(32), f"{rng.choice(['river', 'garden'])}-{rng.choice(['stone', 'letter'])}-window-{rng.randrange(999)}",
             "".join(str(rng.randrange(10)) for _ in range(16)), hexa(40), mixed(32)][kind]
        lead = ["token = \"", "password: ", "", "", "", ""][kind]
        if kind >= 4:
            truth[i] = True  # a secret without a name before it
        elif kind == 3:
            truth[i] = False  # most of these have a wrong check digit: undecided as well
        rows.append((i, f"{prose(6)} {lead}{s} {prose(6)}", "src"))
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    found = secret_scan.findings(docs).select("doc_id", "finding", "before", "after", "path")
    undecided = {r.doc_id for r in secret_scan.rule_labels(found).filter("label is null").collect()}
    out = {r.doc_id: r.is_secret for r in secret_scan.scan(docs).filter(F.length("finding") >= 16).collect()}
    asked = [i for i in undecided if i in truth]
    right = sum(out[i] == truth[i] for i in asked)
    assert len(asked) > 300 and any(truth[i] for i in asked) and any(not truth[i] for i in asked)
    assert right >= 0.95 * len(asked), (right, len(asked))
