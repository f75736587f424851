import ipaddress
import random

from pyspark.sql import functions as F

from feedloom.functions import ips


def spelled(draw):
    """IPv6 text or CIDR, right, nearly right or wrong."""
    groups = [draw.choice(["0", "0", "0", "1", "ab", "00ff", "FFFF", "8000"]) for _ in range(8)]
    if draw.random() < 0.6:
        a, b = sorted(draw.sample(range(9), 2))
        text = ":".join(groups[:a]) + "::" + ":".join(groups[b:])
    else:
        text = ":".join(groups[: draw.choice([8, 8, 8, 7, 9])])
    if draw.random() < 0.2:
        text = text.rpartition(":")[0] + ":" + draw.choice(["1.2.3.4", "255.255.255.255", "1.2.3", "256.1.1.1", "01.2.3.4", "0.0.0.0"])
    if draw.random() < 0.5:
        text += draw.choice(["/64", "/0", "/128", "/129", "/", "/012", "/1/2", "/a", "/-1", "/3", "/65", "/127", "/0000000000000000000064"])
    if draw.random() < 0.1:
        text = draw.choice(["%eth0", "%", "::", ":", " ", "g", "12345:", "%a%b"]).join([text[: (k := draw.randrange(len(text) + 1))], text[k:]])
    return text


FIXED = ["::", "::1", "1::", ":", "", ":::", "1:2:3:4:5:6:7::", "::2:3:4:5:6:7:8", "1::2::3", "1:2:3:4:5:6:7:8::", "::ffff:1.2.3.4", "::ffff:0:0/96",
         "fe80::1%eth0", "fe80::1%", "1.2.3.4", "1:2:3:4:5:6:1.2.3.4", "::1.2.3.4/100", "1:2:3:4:5:6:7:1.2.3.4", "0:0:0:0:0:0:0:0", "a:0:0:b:0:0:0:c"]


def expected(text):
    try:
        net = ipaddress.IPv6Network(text, strict=False)
    except ValueError:
        return None
    return str(net.network_address.__class__(int(net.network_address))), net.prefixlen


def test_networks_equal_the_standard_library(spark):
    draw = random.Random(6)
    texts = list(dict.fromkeys(FIXED + [spelled(draw) for _ in range(4000)]))
    df = spark.createDataFrame([(t,) for t in [*texts, None]], "t string").select("t", ips.v6_parts("t").alias("p"))
    rows = df.select("t", ips.v6_text("p.hi", "p.lo").alias("ip"), F.col("p.length").alias("n")).collect()
    got = {r.t: None if r.n is None else (r.ip, r.n) for r in rows}
    wanted = {t: expected(t) for t in texts} | {None: None}
    assert {t: (got[t], wanted[t]) for t in wanted if got[t] != wanted[t]} == {}
    assert 1000 < sum(x is not None for x in wanted.values()) < 3500


def test_text_of_all_runs_of_zeros(spark):
    numbers = [sum((0xA0 + k if bits >> k & 1 else 0) << 16 * k for k in range(8)) for bits in range(256)]
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    rows = [(str(ipaddress.IPv6Address(n)), signed(n >> 64), signed(n & 2**64 - 1)) for n in [*numbers, 2**128 - 1, 2**127, 2**63]]
    df = spark.createDataFrame(rows, "want string, hi bigint, lo bigint").select("want", ips.v6_text("hi", "lo").alias("got"))
    assert [(r.want, r.got) for r in df.collect() if r.want != r.got] == []
