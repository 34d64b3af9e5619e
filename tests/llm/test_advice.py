
import random
import re
import string
import textwrap

import duckdb
import numpy as np
import pytest

from rankforge.llm import licenses, mixing, secrets


def lognormal(n, seed=11):
    return np.unique(np.random.default_rng(seed).lognormal(6.5, 1.2, n).astype(np.int64) + 1, return_counts=True)


@pytest.mark.parametrize("n, slack", [(20_000, 0.04), (2_000, 0.1)])
def test_every_band_of_lengths_gives_its_share(n, slack):
    lengths, counts = lognormal(n)
    total = int((lengths * counts).sum())
    takes = []
    for seed in range(8):
        take = mixing.fill(lengths, counts, int(total * 0.35), seed)
        assert (take <= counts).all() and (lengths * take).sum() == int(total * 0.35)
        takes.append(take)
    assert any((a != takes[0]).any() for a in takes)
    mean = np.mean(takes, axis=0)
    for a, b in ((0, 300), (300, 1000), (1000, 3000), (3000, 6000), (6000, 10**9)):
        band = (lengths >= a) & (lengths < b)
        assert abs(mean[band].sum() / counts[band].sum() - 0.35) < slack, (a, b)


def test_the_fit_is_exact_for_long_documents():
    take = mixing.fill(np.array([100_000, 150_000, 200_000]), np.array([1, 1, 1]), 300_000)
    assert take.tolist() == [1, 0, 1]
    for n, lost in ((10, 0.002), (60, 0.0)):
        rng = np.random.default_rng(n)
        lengths = np.sort(rng.choice(np.arange(66_000, 200_000), n, replace=False))
        budget, counts = int(lengths.sum()) // 2, np.ones(n, dtype=np.int64)
        tokens = int((lengths * mixing.fill(lengths, counts, budget)).sum())
        if n == 10:
            sums = {0}
            for x in lengths.tolist():
                sums |= {s + x for s in sums}
            assert tokens == max(s for s in sums if s <= budget)
        assert budget * (1 - lost) <= tokens <= budget, n


def budgets(spark, tokens, **options):
    lengths = spark.createDataFrame([(s, 1, n) for s, n in tokens.items()], "source string, n_tokens bigint, n bigint")
    return {r.source: r.take for r in mixing.plan(lengths, **options).collect()}


def test_a_tiny_source_does_not_set_the_total(spark):
    got = budgets(spark, {"big": 5_000_000, "half": 1_250_000, None: 5})
    assert got[None] == 5 and abs(sum(got.values()) - 0.5 * 6_250_005) <= 2
    assert got["half"] == 1_041_665 and got["big"] == 2_083_331  # weights 2 : 1 for what the tiny source leaves


def test_deficits_of_short_sources_go_to_the_others(spark):
    tokens = {"a": 100, "b": 1000, "c": 10_000}
    assert budgets(spark, tokens, weights={"a": 1, "b": 1, "c": 2}, budget=2800) == {"a": 100, "b": 900, "c": 1800}
    assert budgets(spark, tokens, weights={"a": 1, "b": 1, "c": 2}, budget=5100) == {"a": 100, "b": 1000, "c": 4000}
    assert budgets(spark, tokens, weights={"a": 1, "b": 1}, budget=10**6) == {"a": 100, "b": 1000}
    assert budgets(spark, {"a": 4000, "b": 1000}) == {"a": 2000, "b": 1000}  # as before where no source is tiny


def base64(n, seed=3):
    rng = random.Random(seed)
    return "".join(rng.choices(string.ascii_letters + string.digits + "+/", k=n))


def redacted(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    return [r.text for r in secrets.redact(docs).orderBy("doc_id").collect()]


def test_private_keys_are_masked_whole(spark):
    lines = "\n".join(base64(64, i) for i in range(24)) + "\n" + base64(10) + "=="
    head, end = "-----BEGIN RSA PRIVATE KEY-----", "-----END RSA PRIVATE KEY-----"
    pem = f"{head}\nProc-Type: 4,ENCRYPTED\nDEK-Info: AES-128-CBC,0011\n\n{lines}\n{end}"
    pgp = f"-----BEGIN PGP PRIVATE KEY BLOCK-----\nVersion: x-1\n\n{lines}\n=aB3d\n-----END PGP PRIVATE KEY BLOCK-----"
    texts = [f"a {pem} z", f"a {pgp} z", "a " + pem.replace("\n", "\\n") + " z", f"a {pem}\n{pgp} z", f"a {pem[: -len(end)]}", f"a {head} and no more", f"a {pem[: -len(end)]}\n\n{pem} z", f"a {pem[: -len(end)]}\n- it ends z"]
    assert redacted(spark, texts) == ["a [secret] z", "a [secret] z", "a [secret] z", "a [secret]\n[secret] z", "a [secret]\n", "a [secret] and no more", "a [secret]\n\n\n[secret] z", "a [secret]\n\n- it ends z"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    got = sorted((r.doc_id, r.occurrence, r.secret_chars, r.sha256) for r in secrets.scan(docs).collect() if r.rule == "private_key")
    assert got[0][2] == len(pem) and got[1][2] == len(pgp) and got[0][3] != got[1][3]
    documents = docs.toPandas()  # noqa: F841, read by the SQL
    want = sorted(duckdb.sql(f"SELECT doc_id, occurrence, secret_chars, sha256 FROM ({secrets.ORACLE_SQL}) WHERE rule = 'private_key'").fetchall())
    assert got == want


def test_long_secrets_and_names_of_many_segments(spark):
    value = base64(40, 5).replace("+", "x").replace("/", "y")
    long = value * 60
    whole = [f"AWS_SECRET_ACCESS_KEY={value}", f'aws_secret_access_key = "{value}"', f"MY_APP_API_KEY={value}", f"DB_PROD_PASSWORD={value}", f"secret_key={value}", f"API_KEY_V2_PROD={value}", f"_db__password_: {value}", f"token={long}"]
    whole += [f"eyJ{long}.eyJ{long}.{long}", f"redis://:{value}@", f"https://{long}:{long}@", f"ghp_{long}", f"glpat-{long}", f"xoxb-{long}", f"sk_live_{long}"]
    assert redacted(spark, [f"a {x} z" for x in whole]) == ["a [secret] z"] * len(whole)
    assert redacted(spark, [f"my-app-{x} z" for x in whole[:6]]) == ["my-[secret] z"] * 6
    plain = ["the secret of a token is passwords", "http://host:80/path@", "redis://host:6379/0", "secret_key = short"]
    assert redacted(spark, plain) == plain
    texts = [f"{before}{x} z" for x in whole for before in ("a ", "my-app-", "a_b-")] + plain
    documents = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    got = sorted((r.doc_id, r.rule, r.occurrence, r.secret_chars, r.sha256) for r in secrets.scan(documents).collect())
    documents = documents.toPandas()
    assert got == sorted(duckdb.sql(f"SELECT doc_id, rule, occurrence, secret_chars, sha256 FROM ({secrets.ORACLE_SQL})").fetchall())


def test_every_kind_of_license_line_is_found(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir.replace('sf0.001', 'sf0.1')}/documents.parquet").select("doc_id", "text")
    lines = {(r.doc_id, i) for r in docs.collect() for i, line in enumerate(r.text.split("\n"), 1) if re.search(r"(?i)\blicen[sc]ed?\b|rights reserved|copyright|public domain", line)}
    got = {(r.doc_id, r.first_line) for r in licenses.scan(docs).collect() if r.first_line == r.last_line}
    assert len(lines) > 300 and lines == got
    assert [r.license for r in licenses.scan(spark.createDataFrame([(1, "(c) 2020 X. All rights reserved.")], "doc_id int, text string")).collect()] == ["all-rights-reserved"]


def blocks_by_hand(text, words, need, most):
    lines = [set(licenses.words_of(x)) & words for x in text.split("\n")]
    runs = {(i, j): set().union(*lines[i : j + 1]) for i in range(len(lines)) for j in range(i, min(len(lines), i + most))}
    good = {k: len(v) for k, v in runs.items() if len(v) >= need}
    return {(i + 1, j + 1, n) for (i, j), n in good.items() if not any((a, b) in good for a in range(i, j + 1) for b in range(a, j + 1) if (a, b) != (i, j))}


def test_wrapped_notices_are_found(spark):
    """Statements wrapped at several widths, behind comment marks and among other lines; every block against brute force, and against the SQL."""
    names, marks = ["mit-grant", "bsd-3-clause", "gpl-2.0", "isc", "apache-2.0-use", "cc-by-4.0"], ["", "# ", " * ", "// ", "> ", "\t; "]
    texts = []
    for i, (name, width) in enumerate((n, w) for n in names for w in (24, 40, 76, 10_000)):
        mark = marks[i % len(marks)]
        body = textwrap.wrap(licenses.TEMPLATES[name], width)
        texts.append("\n".join(mark + x for x in ["Copyright (c) 2020 Имя", "the of and", *body, "", "other text", *body[:1]]).replace("\n", "\r\n" if i % 3 == 1 else "\n"))
    more = [None, "", "\n\n", "слово\nслово", "all\n\n\n\n\nrights\n\n\n\n\nreserved"]
    documents = spark.createDataFrame([*enumerate(texts + more)], "doc_id int, text string")
    got = sorted((r.doc_id, r.license, r.first_line, r.last_line, r.overlap) for r in licenses.scan(documents).collect())
    want = []
    for i, text in enumerate(texts + more):
        for k, v in licenses.TEMPLATES.items():
            w = set(licenses.words_of(v))
            want += [(i, k, *x) for x in blocks_by_hand(text or "", w, licenses.needed(len(w), licenses.THRESHOLD), licenses.span(v))]
    assert got == sorted(want)
    assert {(i // 4, names[i // 4]) for i in range(len(texts))} == {(i // 4, k) for i, k, *_ in got if k == names[i // 4]}
    assert all(any(g[:2] == (i, names[i // 4]) for g in got) for i in range(len(texts)))
    documents = documents.toPandas()
    assert got == sorted(duckdb.sql(f"SELECT doc_id, license, first_line, last_line, overlap FROM ({licenses.ORACLE_SQL})").fetchall())


def test_a_long_text_is_scanned_by_pieces(spark):
    text = "\n".join(f"no words of it {i} été" for i in range(200_000)) + "\nReleased under\n# the MIT License.\n" + "x" * 5_000_000
    got = [(r.first_line, r.last_line) for r in licenses.scan(spark.createDataFrame([(1, text)], "doc_id int, text string")).collect() if r.license == "mit"]
    assert got == [(200_001, 200_002)]
