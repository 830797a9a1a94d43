"""Address ranges as a table, list syntaxes and names below a listed one, against plain versions."""

import ipaddress
import random

import pytest
from pyspark.sql import functions as F

from tidewatch.functions import net
from tidewatch.operators import filters, ranges
from tidewatch.sources import lists

ADDRESSES = ["1.2.3.4", "01.002.3.4", "255.255.255.255", "256.1.1.1", "1.2.3", "", "x", "::", "::1", "2001:db8::1",
             "2001:DB8:0:0:0:0:0:1", "2001:db8::1:0:0:1", "fe80::1%eth0", "::ffff:1.2.3.4", "::FFFF:102:304", "1::2::3",
             "1:2:3:4:5:6:7", "1:2:3:4:5:6:7:8", "1:2:3:4:5:6:7:8:9", "1:2:3:4:5:6:7::", "::2:3:4:5:6:7:8", "12345::",
             "64:ff9b::192.0.2.33", "::1.2.3.4", "::ffff:1.2.3.400", ":1::2", "1:::2", "g::1", "1:2:3:4:5:6:1.2.3.4",
             "1:2:3:4:5:6:7:1.2.3.4", None, "::ffff:0:1.2.3.4"]


def plain_hex(text):
    if text is None:
        return None
    if net_like(text):
        return "".join(f"{int(o):02x}" for o in text.split("."))
    try:
        address = ipaddress.IPv6Address(text.split("%")[0])
    except ValueError:
        return None
    mapped = address.ipv4_mapped
    return (mapped or address).packed.hex()


def net_like(text):
    parts = text.split(".")
    return len(parts) == 4 and all(p.isdigit() and len(p) <= 3 and int(p) <= 255 for p in parts)


def test_address_digits(spark):
    rows = spark.createDataFrame([(a,) for a in ADDRESSES], "a string").select("a", net.address_hex(F.col("a")).alias("h"))
    assert {r.a: r.h for r in rows.collect()} == {a: plain_hex(a) for a in ADDRESSES}


def random_address(draw):
    if draw.random() < 0.4:
        return ".".join(str(draw.choice([10, 10, 192, draw.randrange(256)])) for _ in range(4))
    value = draw.choice([0x20010DB8 << 96, 0xFE80 << 112, 0, 0xFFFF << 32]) | draw.getrandbits(draw.choice([4, 32, 70, 128]))
    address = ipaddress.IPv6Address(value & (1 << 128) - 1)
    return draw.choice([str(address), address.exploded.upper()])


@pytest.mark.parametrize("seed", [1, 2])
def test_longest_range_equals_a_plain_search(spark, rows, seed):
    draw = random.Random(seed)
    table = []
    for _ in range(150):
        a = random_address(draw)
        bits = 32 if ":" not in a else 128
        table.append(f"{a}/{draw.choice([0, 1, 3, 8, 10, 16, 17, 27, 31, bits, min(bits, 64), min(bits, 127)])}")
    table += ["10.0.0.0/8", "10.0.0.0/8", "10.1.2.3/8", " 10.10.0.0/16 ", "10.10.10.10", "no", "1.2.3.4/33", "::/129", "1.2.3.4/",
              None, "::ffff:10.0.0.0/104"]
    addresses = [random_address(draw) for _ in range(400)] + ["10.10.10.10", "::ffff:10.1.1.1", "bad", None, "10.10.10.10"]
    compiled = ranges.compile_ranges(spark.createDataFrame([(t,) for t in table], "range string"))

    known = {}
    for text in table:
        try:
            network = ipaddress.ip_network((text or "").strip(), strict=False)
        except ValueError:
            continue
        bits, digits = network.prefixlen, network.network_address.packed
        if network.version == 6 and network.network_address.ipv4_mapped and bits >= 96:
            bits, digits = bits - 96, network.network_address.ipv4_mapped.packed
        key = (len(digits), int.from_bytes(digits) >> (len(digits) * 8 - bits), bits)
        known[key] = min(text, known.get(key, text))

    def longest(text):
        digits = plain_hex(text)
        if digits is None:
            return None, None
        n = len(digits) // 2
        for bits in range(n * 8, -1, -1):
            hit = known.get((n, int(digits, 16) >> (n * 8 - bits), bits))
            if hit:
                return hit, bits
        return None, None

    assert {(r.range, r.length) for r in compiled.collect()} == {(t, k[2]) for k, t in known.items()}
    df = spark.createDataFrame(list(enumerate(addresses)), "id int, address string")
    expected = [(i, *longest(a)) for i, a in enumerate(addresses)]
    assert rows(ranges.longest_range(df, "address", compiled), "id", "range", "prefix_length") == sorted(expected, key=repr)
    inside = ranges.in_ranges(df, "address", compiled)
    assert inside.columns == df.columns and inside.count() == sum(e[1] is not None for e in expected)
    bad = ranges.invalid_ranges(spark.createDataFrame([(t,) for t in table], "range string"))
    assert rows(bad) == sorted([(t,) for t in ("no", "1.2.3.4/33", "::/129", "1.2.3.4/")], key=repr)


def test_nothing_to_look_up(spark):
    empty = ranges.compile_ranges(spark.createDataFrame([], "range string"))
    one = spark.createDataFrame([("1.2.3.4",)], "a string")
    assert [tuple(r) for r in ranges.longest_range(one, "a", empty).collect()] == [("1.2.3.4", None, None)]
    assert ranges.longest_range(one.limit(0), "a", empty).count() == 0


def test_configured_ranges_of_any_length(spark, rows):
    texts = ["2001:db8:1:2::5", "2001:db8:1:3::5", "2001:0DB8:1:2:0::9", "10.1.2.3", None, "x"]
    df = spark.createDataFrame([(t,) for t in texts], "a string")
    found = df.select("a", net.in_cidr(F.col("a"), ["2001:db8:1:2::/64", "10.0.0.0/8"]).alias("ok"))
    assert {r.a: r.ok for r in found.collect()} == dict(zip(texts, [True, False, True, True, False, False]))


LINES = ["! comment", "[Adblock Plus]", "# hash", "", "  ", "||ads.example.com^", "||opt.example.com^$third-party", "*.wild.com",
         "x.com.", "::1 ip6-localhost", "127.0.0.1 localhost a.com B.com", "0.0.0.0 0.0.0.0", "@@||good.com^", "||path.com/x^",
         "plain.org # note", "1.2.3.4", "bad_label-.com", "under_score.com", "single", "a..b", "x" * 64 + ".com", ".dot.net",
         "plain.org", "||a.com^", "e.com#no-comment"]


def test_list_syntaxes(spark, rows):
    lines = spark.createDataFrame([(x,) for x in LINES], "value string")
    assert rows(lists.compile_blocklist(lines)) == sorted([(x,) for x in (
        "ads.example.com", "opt.example.com", "wild.com", "x.com", "a.com", "b.com", "plain.org", "under_score.com",
        "dot.net")], key=repr)
    junk = {r.entry for r in lists.list_junk(lines).collect()}
    assert junk == {"ip6-localhost", "localhost", "0.0.0.0", "@@||good.com^", "||path.com/x^", "1.2.3.4", "bad_label-.com",
                    "single", "a..b", "x" * 64 + ".com", "e.com#no-comment"}


def test_names_below_a_listed_name(spark, rows):
    draw = random.Random(4)
    labels = ["a", "b", "c", "x"]
    listed = {".".join(draw.choice(labels) for _ in range(draw.randint(1, 3))) + ".com" for _ in range(25)}
    names = [".".join(draw.choice(labels) for _ in range(draw.randint(0, 5))) + draw.choice([".com", ".org", ".COM", ".com."])
             for _ in range(500)] + [None, "", ".", "com", "a" * 300]

    def parent(name):
        text = (name or "").lower()
        text = text[:-1] if text.endswith(".") else text
        fits = [x for x in listed if text == x or text.endswith("." + x)]
        return min(fits, key=len, default=None)

    dns = spark.createDataFrame(list(enumerate(names)), "id int, domain string")
    blocklist = spark.createDataFrame([(x,) for x in listed] * 2, "domain string")
    expected = [(i, parent(n)) for i, n in enumerate(names)]
    assert rows(filters.listed_parents(dns, blocklist), "id", "listed") == sorted(expected, key=repr)
    hit = [e for e in expected if e[1]]
    assert rows(filters.blocked_below(dns, blocklist), "id", "listed") == sorted(hit, key=repr) and len(hit) > 50
    assert filters.allowed_outside(dns, blocklist).count() == len(names) - len(hit)
