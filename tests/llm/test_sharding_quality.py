import collections
import math
import random
import re
import zlib

from compare import assert_same
from pyspark.sql import functions as F

from actispark.llm import quality, sharding


def test_shards(spark, sf_dir, texts):
    rows = sharding.op2_kd_sharding(spark, sf_dir).collect()
    size, slots, of = collections.Counter(), collections.defaultdict(list), collections.defaultdict(set)
    for r in rows:
        data = texts[r["doc_id"]].encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(data) + 8, zlib.crc32(data), "bytes", None)
        size[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
        of[data].add(r["shard"])
    assert len(rows) == len(texts) and set(size) <= set(range(24))
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    mean = sum(size.values()) / 24
    assert max(abs(s - mean) for s in size.values()) <= 0.02 * mean + max(r["size"] for r in rows)


def test_large_group_of_equal_texts_is_cut(spark):
    df = spark.createDataFrame([(i, "same text", "en", "a", 9) for i in range(240)], "doc_id long, text string, lang string, source string, n_chars long")
    counts = collections.Counter(r["shard"] for r in sharding.shard_documents(df).collect())
    assert set(counts.values()) == {10}


def test_small_groups_stay_together(spark):
    df = spark.createDataFrame([(i, f"text {i // 4}", "en", "a", 9) for i in range(12000)], "doc_id long, text string, lang string, source string, n_chars long")
    of = collections.defaultdict(set)
    for r in sharding.shard_documents(df).collect():
        of[r["text_crc32"]].add(r["shard"])
    assert max(map(len, of.values())) == 1


def brute_kd(rows, dims, shards):
    """rows: (size, text_key, row_key, *values); the shard of each, by sorting whole nodes."""
    widths = [(max(r[3 + d] for r in rows) - min(r[3 + d] for r in rows)) or 1.0 for d in range(dims)]
    out, at = {}, 0

    def split(part, n):
        nonlocal at
        if n == 1 or not part:
            for r in part:
                out[r[2]] = at
            at += 1
            return
        d = max(range(dims), key=lambda d: (max(r[3 + d] for r in part) - min(r[3 + d] for r in part)) / widths[d])
        part = sorted(part, key=lambda r: (r[3 + d], r[1], r[2]))
        target, sums = sum(r[0] for r in part) * (n // 2) / n, [0]
        for r in part:
            sums.append(sums[-1] + r[0])
        i = next(i for i, s in enumerate(sums) if s >= target)
        cut = i - 1 if target - sums[i - 1] <= sums[i] - target else i
        split(part[:cut], n // 2)
        split(part[cut:], n - n // 2)

    split(rows, shards)
    return out


def test_tree_equals_brute_force(spark):
    rng = random.Random(5)
    rows = [(rng.randrange(8, 2000), float(rng.randrange(300)), float(i), float(rng.randrange(6)), rng.random() ** 3, float(rng.choice([0, 1, 1, 1, 7]))) for i in range(1500)]
    df = spark.createDataFrame(rows, "size long, text_key double, row_key double, a double, b double, c double")
    for shards in (2, 5, 24):
        got = {r["row_key"]: r["shard"] for r in sharding.kd_shards(df, ["a", "b", "c"], shards, slack=0.0, close=0.0).collect()}
        assert got == brute_kd(rows, 3, shards)


def test_ordinals_keep_order(spark):
    names = ["src0", "src1", "src10", "src2", "src", None, "srcé", "srczzzzzzzzz1"]
    df = spark.createDataFrame([(n, n) for n in names], "source string, name string")
    got = sorted(df.select("name", *sharding.ordinals(df, ["source"])).collect(), key=lambda r: (r["source"], r["name"] or ""))
    assert [r["name"] for r in got] == sorted(names, key=lambda n: (n or "").encode())


def test_odd_shards(odd_documents, no_documents):
    rows = sharding.shard_documents(odd_documents).collect()
    assert len(rows) == 10 and sum(r["size"] == 8 for r in rows) == 2
    assert sharding.shard_documents(no_documents).count() == 0


def plain(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    found = collections.defaultdict(list)
    for i in range(len(w) - 4):
        found[tuple(w[i : i + 5])].append(i)
    covered = {i + k for v in found.values() if len(v) > 1 for i in v for k in range(5)}
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(covered)


def test_quality_numbers(spark, sf_dir, texts):
    rows = quality.op3_line_frequency(spark, sf_dir).collect()
    assert len(rows) == len(texts)
    for r in rows:
        n = plain(texts[r["doc_id"]])
        assert tuple(r[c] for c in quality._NUMBERS) == n
        assert r["base_failed"] == (n[0] < 10 or 100 * n[4] > 20 * n[0])
        assert not (r["kept"] and r["base_failed"])


def test_frequent_lines_deplete(spark):
    words = lambda i, n: " ".join(chr(97 + i % 26) + chr(97 + i // 26) + chr(97 + k) for k in range(n))
    rows = [(i, f"Common line of this host number {10 + i}\n{words(i, 20)}", "a") for i in range(60)]  # digits are equal
    rows += [(100 + i, f"Common line of this host number 77\n{words(i, 4)}", "a") for i in range(5)]
    rows += [(200 + i, "one text that has many exact copies and more words than ten in it", "a") for i in range(50)]
    got = {r["doc_id"]: r for r in quality.judge(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert all(got[i]["kept"] and got[i]["n_removed_words"] == 7 for i in range(60))
    assert not any(got[100 + i]["kept"] for i in range(5)) and not got[100]["base_failed"]
    assert all(got[200 + i]["kept"] for i in range(50))


def test_stage_keeps_what_judge_keeps(documents):
    kept = {r["doc_id"] for r in quality.judge(documents).collect() if r["kept"]}
    assert {r["doc_id"] for r in quality.keep_good(documents, small=-1).collect()} == kept
    out = quality.keep_good(documents)
    assert out.columns == documents.columns and {r["doc_id"] for r in out.collect()} == kept


def test_odd_quality(odd_documents, no_documents):
    assert sum(r["kept"] for r in quality.judge(odd_documents).collect()) == 2  # the two texts of thirteen words
    assert quality.judge(no_documents).count() == 0 == quality.keep_good(no_documents).count()
    assert [sorted(map(str, quality.keep_good(odd_documents, small=n).collect())) for n in (-1, 100)][0] == sorted(map(str, quality.keep_good(odd_documents).collect()))


def own(i, n=12):
    return " ".join(chr(97 + i % 26) + chr(97 + i // 26 % 26) + chr(97 + i // 676) + chr(97 + k) for k in range(n))


def test_frequent_lines_are_cut(spark):
    """Whole texts come back without these lines, however written, and with all others in their order."""
    rows = []
    for i in range(60):
        rows.append((i, f"All rights reserved by Host {i}\n\n{own(i)}\n  \tAll Rights reserved by  host 7 \nend of {own(i, 3)}\n", "a"))
    rows += [(100 + i, rows[0][1], "a") for i in range(3)]  # exact copies
    rows += [(200, rows[0][1], "b"), (201, "é " + own(201) + "\nall rights reserved by host 1", "a"), (202, own(202) + "\r\nlast", "a")]
    schema = "doc_id long, text string, source string, n_chars int, extra string"
    docs = spark.createDataFrame([(d, t, s, len(t), f"x{d}") for d, t, s in rows], schema)
    out = quality.keep_good(docs)
    assert out.schema == docs.schema
    assert sorted(map(str, out.collect())) == sorted(map(str, quality.keep_good(docs, small=0).collect()))  # the way for many lines
    got = {r["doc_id"]: r for r in out.collect()}
    assert set(got) == {d for d, _, _ in rows}
    want = {d: t for d, t, _ in rows}
    for i in [*range(60), 100, 101, 102]:
        k = 0 if i >= 100 else i
        want[i] = f"\n{own(k)}\nend of {own(k, 3)}\n"
    want[201] = "é " + own(201)
    for d, r in got.items():
        assert (r["text"], r["n_chars"], r["extra"]) == (want[d], len(want[d]), f"x{d}")
    judged = {r["doc_id"]: r for r in quality.judge(docs).collect()}
    assert all(len(r["text"].split()) == judged[d]["n_words"] - judged[d]["n_removed_words"] for d, r in got.items())


def test_large_and_small_hosts_have_boilerplate(spark):
    """A line on 1 % of a large host's texts, and one on each page of a small host; not what is on a few pages."""
    hot = [(i, own(i) + ("\nfooter of the large host" if i % 100 == 0 else "\nnow and then" if i % 100 == 1 and i < 1200 else ""), "hot") for i in range(3000)]
    small = [(5000 + i, own(i) + "\nheader of a small host" + ("\nfour times" if i < 4 else ""), "small") for i in range(10)]
    docs = spark.createDataFrame([*hot, *small, *[(6000 + i, own(i) + "\nthree texts", "tiny") for i in range(3)]], "doc_id long, text string, source string")
    cut = {r["doc_id"]: r["n_removed_words"] for r in quality.judge(docs).collect()}
    assert {d for d, n in cut.items() if n} == {*range(0, 3000, 100), *range(5000, 5010)}
    assert {cut[d] for d in range(5000, 5010)} == {5}


def test_sql_of_line_frequency(spark, sf_dir):
    assert_same(quality.op3_line_frequency(spark, sf_dir), quality.SQL, sf_dir)


def test_limit_depends_on_host_size_alone(spark):
    """The same host doubled by other texts: its limit moves by one document, and no line by a switch."""
    for n in (8, 16, 32, 64):
        most = int(1 + math.log2(1 + n))
        rows = [(i, own(i) + ("\nabove the limit" if i <= most else "") + ("\nat the limit" if i < most else ""), "a") for i in range(n)]
        cut = {r["doc_id"]: r["n_removed_words"] for r in quality.judge(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
        assert cut == {i: 3 * (i <= most) for i in range(n)}


def test_limit_is_a_stable_share_of_large_hosts(spark):
    """Lines on 2 and on 0.5 in a thousand texts: of hosts of 40,000 and of 80,000 texts the first go and the second stay; a
    host of 10 keeps its floor."""
    hosts = {"small": 10, "large": 40_000, "larger": 80_000}
    rows = None
    for at, (host, n) in enumerate(hosts.items()):
        i = F.col("id")
        line = F.when(i % 500 == 0, "\nabove the share").when(i % 2000 == 1, "\nbelow the share").otherwise("")
        line = F.concat(line, F.when(F.lit(n == 10) & (i < 5), "\nfive of ten").otherwise(""))
        letters = F.translate(F.format_string("%07d", i + at * 10**6), "0123456789", "abcdefghij")
        text = F.concat(F.array_join(F.transform(F.sequence(F.lit(1), F.lit(12)), lambda k: F.concat(letters, F.char(k + 106))), " "), line)
        of = spark.range(n).select((i + at * 10**6).alias("doc_id"), text.alias("text"), F.lit(host).alias("source"))
        rows = of if rows is None else rows.unionByName(of)
    cut = quality.judge(rows).where("n_removed_words > 0").select("doc_id", F.col("doc_id") % 10**6).collect()
    want = {at * 10**6 + i for at, n in ((1, 40_000), (2, 80_000)) for i in range(0, n, 500)} | set(range(5))
    assert {r["doc_id"] for r in cut} == want


def test_huge_texts(huge_documents):
    got = {r["doc_id"]: r for r in quality.judge(huge_documents).collect()}
    assert len(got) == 9 and all(tuple(got[i][c] for c in quality._NUMBERS) == plain(r["text"]) for i, r in {r["doc_id"]: r for r in huge_documents.collect()}.items())
    assert quality.keep_good(huge_documents).count() == sum(r["kept"] for r in got.values())
