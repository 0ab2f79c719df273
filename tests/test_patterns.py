"""Properties over many random strings in one job each."""

import random
import re
import string

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from scrubline.functions import remove_isolated_letters, remove_symbol_runs, replace_emails, replace_numbers, replace_phone_numbers, replace_urls, replace_years

DIGITS = st.text("0123456789", min_size=1, max_size=6)
WORDS = st.text(string.ascii_lowercase + string.digits, min_size=2, max_size=8)
LABELS = st.lists(WORDS, min_size=1, max_size=3).map("-".join)
SITES = st.tuples(st.lists(LABELS, min_size=1, max_size=3).map(".".join), st.sampled_from(["com", "org", "de", "co.uk"])).map(".".join)
TOKENS = st.text(string.ascii_letters + string.digits, max_size=4)

CASES = {
    "email": (replace_emails, st.tuples(st.lists(WORDS, min_size=1, max_size=3).map(".".join), st.sampled_from(["@", "(at)", "[at]", "<at>"]), SITES).map("".join)),
    "url": (replace_urls, st.tuples(st.sampled_from(["http://", "https://", "ftp://", "www.", "www2."]), SITES, st.sampled_from(["", "/", "/a/b?c=d#e", ":8080/x"])).map("".join)),
    "year": (replace_years, st.integers(1900, 2099).map(str)),
    "phone": (replace_phone_numbers, st.tuples(st.sampled_from(["", "+49 ", "0049-", "+1."]), st.sampled_from(["", "(030) ", "555-"]), st.sampled_from(["123 4567", "987-6543", "5551234"]), st.sampled_from(["", " x12", " ext. 99"])).map("".join)),
    "number": (replace_numbers, st.one_of(DIGITS, DIGITS.map("-".__add__), st.tuples(DIGITS, DIGITS).map(".".join), st.integers(1000, 10**9).map("{:,}".format))),
    "letters": (lambda t, token: remove_isolated_letters(t), st.lists(st.sampled_from("bcdxyzI"), min_size=1, max_size=6).map(" ".join)),
    "symbols": (lambda t, token: remove_symbol_runs(t), st.text(":_.|><;}@~!?+#)({,/^\\", min_size=1, max_size=9)),
}


@pytest.mark.parametrize("name", CASES)
def test_what_is_found_is_replaced_whole(spark, name):
    function, strings = CASES[name]
    found = []

    @settings(max_examples=300, database=None, derandomize=True, suppress_health_check=list(HealthCheck))
    @given(strings, TOKENS)
    def gather(s, token):
        found.append((s, token))

    gather()
    tokens = sorted({t for _, t in found})[:12]
    df = spark.createDataFrame([(s, t) for s, t in found if t in tokens] + [(s, "T") for s, _ in found], "s string, token string")
    got = None
    for t in [*tokens, "T"]:
        part = df.filter(F.col("token") == t).select("s", "token", function(F.col("s"), t).alias("out"))
        got = part if got is None else got.union(part)
    wrong = [tuple(r) for r in got.collect() if r["out"] != ("" if name in ("letters", "symbols") else r["token"])]
    assert not wrong[:5]


def python_years(text):
    return re.sub(r"(?<!\w)(?:19|20)[0-9]{2}(?!\w)", "<YEAR>", text)


def test_years_like_python(spark):
    rng = random.Random(4)
    texts = ["".join(rng.choice("19 20é2_05-.") for _ in range(30)) for _ in range(3000)]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", replace_years(F.col("t")).alias("x")).collect()
    assert [r["x"] for r in rows] == [python_years(r["t"]) for r in rows]


def test_symbol_runs_like_python(spark):
    rng = random.Random(5)
    texts = ["".join(rng.choice("ab1é .,!(:$") for _ in range(25)) for _ in range(3000)]
    runs = re.compile(r"[.,!(:]+")

    def python(t):
        def cut(m):
            a, b = m.span()
            left = a > 0 and t[a - 1].isascii() and t[a - 1].isalnum()
            right = b < len(t) and t[b].isascii() and t[b].isalnum()
            return t[a:b] if b - a <= left + right else t[a : a + left] + t[b - right : b] if right else t[a : a + left]

        return runs.sub(cut, t)

    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", remove_symbol_runs(F.col("t")).alias("x")).collect()
    assert [r["x"] for r in rows] == [python(r["t"]) for r in rows]


def test_long_local_parts_are_replaced_whole(spark):
    runs = ["a" * 1001, "é" * 5000, "a-" * 3000 + "b", "+" * 2000, "a." + "b" * 4000, "a" * 200_000]
    texts = [(f"{before}{r}@x.com, c", f"{before}<EMAIL>, c") for r in runs for before in ("", "to ", "%")]
    texts += [(f"x.-{r}@x.com", "<EMAIL>") for r in runs] + [(f"){w}-{r}@x.com", f"){w}-<EMAIL>") for r in runs for w in ("", "b")]
    texts += [("a@b.com " + "a-" * 100_000, "<EMAIL> " + "a-" * 100_000), ("@" + "-" * 100_000, "@" + "-" * 100_000)]
    rows = spark.createDataFrame(texts, "t string, want string").select(replace_emails(F.col("t")).alias("x"), "want").collect()
    assert not [k for k, r in enumerate(rows) if r["x"] != r["want"]]


def test_many_groups_and_labels_are_replaced_whole(spark):
    n, host = "1" + ",234" * 5000, "a-b." * 5000 + "com"
    texts = [(n, "<NUMBER>"), (f"x {n}.50 y", "x <NUMBER> y"), ("1" + " 234" * 400, "<NUMBER>"), ("9" + ".234" * 400 + ",5", "<NUMBER>")]
    rows = spark.createDataFrame(texts, "t string, want string").select(replace_numbers(F.col("t")).alias("x"), "want").collect()
    assert not [k for k, r in enumerate(rows) if r["x"] != r["want"]]
    texts = [(f"see http://{host}/x y", "see <URL> y"), (f"www.{host}, ", "<URL>, ")]
    rows = spark.createDataFrame(texts, "t string, want string").select(replace_urls(F.col("t")).alias("x"), "want").collect()
    assert not [k for k, r in enumerate(rows) if r["x"] != r["want"]]
    assert spark.range(1).select(replace_emails(F.lit(f"a@{host} b"))).first()[0] == "<EMAIL> b"


def test_numbers_like_python(spark):
    """Against the same rules with groups that may be given back, where Python has stack enough."""
    grouped = [rf"[1-9]\d{{0,2}}(?:{sep}\d{{3}})+(?:{point}\d*)?" for sep, point in ((",", r"\."), ("[ .]", ","))]
    number = re.compile(rf"(?<![\w,.])[-+–]?(?:{'|'.join([*grouped, r'\d*?[,.]\d+', r'\d+'])})(?:(?=\n?\Z)|\b)")
    rng = random.Random(7)
    texts = ["".join(rng.choice(["1", "23", "456", "000", ",", ".", " ", "a", "-", "\n", ",789", ".321", " 654"]) for _ in range(rng.randint(1, 12))) for _ in range(6000)]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", replace_numbers(F.col("t")).alias("x")).collect()
    assert not [(r["t"], r["x"]) for r in rows if r["x"] != number.sub("<NUMBER>", r["t"])][:5]


def test_hosts_like_python(spark):
    label = r"[a-z]+(?:-[a-z]+)*"
    url = re.compile(rf"(?<![\w/.])http://(?:{label}(?:\.{label})*\.[a-z]{{2,}})(?:/\S*)?")
    rng = random.Random(9)
    texts = ["http://" + "".join(rng.choice(["a", "b", "cd", ".", ".", "-", " "]) for _ in range(rng.randint(1, 14))) for _ in range(6000)]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", replace_urls(F.col("t")).alias("x")).collect()
    assert not [(r["t"], r["x"]) for r in rows if r["x"] != url.sub("<URL>", r["t"])][:5]
