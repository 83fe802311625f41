"""http(s) URLs as browsers write them, by the URL standard, as Column expressions.

Ends lose blanks and controls, tabs and line ends go, backslashes before the query are slashes, schemes and hosts are lower-cased,
hosts of other scripts become ASCII, numbers of one to four parts (decimal, octal, hexadecimal) become dotted IPv4 addresses, IPv6
addresses their shortest form, default ports go, steps of dots (also as %2e) are taken, and each part has its own characters escaped.
What has another scheme, no host, a host with forbidden characters, a bad address or a port over 65,535 gives null, as null does.

Hosts of other scripts are lower-cased and written in Punycode; they are not composed or otherwise mapped first (no accents in two
characters, no full-width letters), nor are labels that begin with xn-- checked. A relative URL that names its base's own scheme (http:x) is read as absolute.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters that each part escapes, and those that no host may hold.
IN_USER = r"""[^\x21-\x7e]|["#<>?^`{}/:;=@\[\]\\|]"""
IN_PATH = r"""[^\x21-\x7e]|["#<>?^`{}]"""
IN_QUERY = r"""[^\x21-\x7e]|["#<>']"""
IN_FRAGMENT = r"""[^\x21-\x7e]|["<>`]"""
NO_HOST = r"[\x00-\x20#%/:<>?@\[\\\]^|\x7f]"

#: URLs that need no change but the case of scheme and host; all others take the long way.
PLAIN = r"^(?!.*(?:/\.|%2[eE]))(?i:https?)://(?:[A-Za-z0-9-]+\.)*[A-Za-z][A-Za-z0-9-]*(?::[1-9][0-9]{0,3})?(?:[/?#][!#-&(-;=?-\[\]_a-z|~]*)?$"
PARTS = r"(?s)^(?i:(https?)):/*([^/?#]*)([^?#]*)(\?[^#]*)?(#.*)?$"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of value, which is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def escaped(text: Column, characters: str) -> Column:
    """text with characters as %XX of their UTF-8 bytes."""
    each = F.transform(F.split(text, ""), lambda c: F.when(c.rlike(characters), F.regexp_replace(F.hex(F.encode(c, "UTF-8")), "(..)", "%$1")).otherwise(c))
    return F.when(text.rlike(characters), F.array_join(each, "")).otherwise(text)


def cleaned(url: Column) -> Column:
    """url without blanks at its ends and without tabs and line ends, with slashes for backslashes before ? and #."""
    bare = F.regexp_replace(F.regexp_replace(url, r"^[\x00-\x20]+|[\x00-\x20]+$", ""), r"[\t\n\r]", "")
    return let(bare, lambda b: F.concat(F.translate(F.regexp_extract(b, r"^[^?#]*", 0), "\\", "/"), F.regexp_extract(b, r"(?s)^[^?#]*(.*)$", 1)))


def whole_part(a: Column, b: Column | int) -> Column:
    """Whole part of a / b."""
    return F.floor(a / b)


def bias_after(delta: Column, points: Column, first: Column) -> Column:
    start = let(whole_part(delta, F.when(first, 700).otherwise(2)), lambda d: d + whole_part(d, points))
    zero = F.struct(F.lit(0).cast("long").alias("k"), start.alias("d"))
    shrink = lambda s, _: F.when(s["d"] > 455, F.struct((s["k"] + 36).alias("k"), whole_part(s["d"], 35).alias("d"))).otherwise(s)
    return F.aggregate(F.sequence(F.lit(1), F.lit(8)), zero, shrink, lambda s: s["k"] + whole_part(s["d"] * 36, s["d"] + 38))


def digits_of(delta: Column, bias: Column) -> Column:
    """delta as a number of variable length, the low digits first."""
    digit = lambda d: F.substr(F.lit("abcdefghijklmnopqrstuvwxyz0123456789"), d.cast("int") + 1, F.lit(1))

    def step(s: Column, k: Column) -> Column:
        t = F.least(F.greatest(k * 36 - bias, F.lit(1).cast("long")), F.lit(26).cast("long"))
        more = F.struct(whole_part(s["q"] - t, 36 - t).alias("q"), F.concat(s["out"], digit(t + (s["q"] - t) % (36 - t))).alias("out"), F.lit(False).alias("done"))
        last = F.struct(s["q"].alias("q"), F.concat(s["out"], digit(s["q"])).alias("out"), F.lit(True).alias("done"))
        return F.when(s["done"], s).when(s["q"] < t, last).otherwise(more)

    zero = F.struct(delta.alias("q"), F.lit("").alias("out"), F.lit(False).alias("done"))
    return F.aggregate(F.sequence(F.lit(1).cast("long"), F.lit(14).cast("long")), zero, step, lambda s: s["out"])


def punycode(label: Column) -> Column:
    """A label of any script in letters, digits and hyphens (RFC 3492)."""
    long = lambda n: F.lit(n).cast("long")
    plain = F.regexp_replace(label, r"[^\x00-\x7f]", "")
    points = F.transform(F.split(label, ""), lambda c: F.ascii(c).cast("long"))

    def state(n: Column, delta: Column, bias: Column, h: Column, out: Column) -> Column:
        return F.struct(n.alias("n"), delta.alias("delta"), bias.alias("bias"), h.alias("h"), out.alias("out"))

    def encoded(ps: Column) -> Column:
        basic = F.length(plain).cast("long")

        def met(s: Column, c: Column) -> Column:
            wrote = state(s["n"], long(0), bias_after(s["delta"], s["h"] + 1, s["h"] == basic), s["h"] + 1, F.concat(s["out"], digits_of(s["delta"], s["bias"])))
            return F.when(c == s["n"], wrote).when(c < s["n"], state(s["n"], s["delta"] + 1, s["bias"], s["h"], s["out"])).otherwise(s)

        def round_of(s: Column, m: Column) -> Column:
            begun = state(m, s["delta"] + (m - s["n"]) * (s["h"] + 1), s["bias"], s["h"], s["out"])
            return let(F.aggregate(ps, begun, met), lambda e: state(e["n"] + 1, e["delta"] + 1, e["bias"], e["h"], e["out"]))

        zero = state(long(128), long(0), long(72), basic, F.when(plain == "", "").otherwise(F.concat(plain, F.lit("-"))))
        higher = F.array_sort(F.array_distinct(F.filter(ps, lambda p: p >= 128)))
        return F.aggregate(higher, zero, round_of, lambda s: s["out"])

    return let(points, encoded)


def ascii_host(host: Column) -> Column:
    """A domain in lower-case ASCII; null where it can't be one."""
    decoded = F.lower(F.try_url_decode(F.replace(host, F.lit("+"), F.lit("%2B"))))

    def written(d: Column) -> Column:
        labels = F.split(F.translate(d, "\u3002\uff0e\uff61", "..."), r"\.")
        wide = F.array_join(F.transform(labels, lambda x: F.when(x.rlike(r"^[\x00-\x7f]*$"), x).otherwise(F.concat(F.lit("xn--"), punycode(x)))), ".")
        return F.when((d != "") & ~d.rlike(NO_HOST), F.when(d.rlike(r"^[\x00-\x7f]*$"), d).otherwise(wide))

    return let(decoded, written)


def ipv4_number(part: Column) -> Column:
    """A part of an IPv4 address as a number; null where it is none, or over ten digits."""

    def in_base(digits: Column, base: int) -> Column:
        short = F.ltrim(digits, F.lit("0"))
        return F.when(short == "", 0).when(F.length(short) <= 11, F.conv(short, base, 10).cast("long"))

    return (
        F.when(part.rlike("^0x[0-9a-f]*$"), in_base(F.substr(part, F.lit(3)), 16)).when(part.rlike("^0[0-7]+$"), in_base(part, 8)).when(part.rlike("^(0|[1-9][0-9]*)$"), in_base(part, 10))
    )


def ipv4(host: Column) -> Column:
    """The dotted form of a host whose last label is a number; null where it is no address."""

    def dotted(n: Column) -> Column:
        address = F.aggregate(
            F.transform(F.slice(n, 1, F.size(n) - 1), lambda p, i: p * F.pow(F.lit(256), 3 - i).cast("long")),
            F.element_at(n, -1),
            lambda total, p: total + p,
        )
        fits = (F.size(n) <= 4) & F.forall(F.slice(n, 1, F.size(n) - 1), lambda p: p <= 255) & (F.element_at(n, -1) < F.pow(F.lit(256), 5 - F.size(n)))
        byte = lambda a, k: F.pmod(F.floor(a / 256**k), F.lit(256)).cast("string")
        return F.when(~F.exists(n, lambda p: p.isNull()) & fits, let(address, lambda a: F.concat_ws(".", *[byte(a, k) for k in (3, 2, 1, 0)])))

    return let(F.transform(F.split(F.regexp_replace(host, r"\.$", ""), r"\."), ipv4_number), dotted)


def ipv6(host: Column) -> Column:
    """[address] in its shortest form; null where it is no address."""
    inner = F.lower(F.regexp_extract(host, r"^\[(.*)\]$", 1))
    tail = r"^(.*:)((?:(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])(?:\.|$)){4})$"
    pair = lambda p, i: F.lower(F.hex(F.get(p, i).cast("long") * 256 + F.get(p, i + 1).cast("long")))
    two = let(F.split(F.regexp_extract(inner, tail, 2), r"\."), lambda p: F.concat_ws(":", pair(p, F.lit(0)), pair(p, F.lit(2))))
    hexed = F.when(inner.rlike(tail), F.concat(F.regexp_extract(inner, tail, 1), two)).otherwise(inner)

    def groups(h: Column) -> Column:
        sides = F.transform(F.split(h, "::"), lambda s: F.when(s == "", F.array().cast("array<string>")).otherwise(F.split(s, ":")))
        known = F.size(F.flatten(sides))
        filled = F.concat(F.get(sides, F.lit(0)), F.array_repeat(F.lit("0"), F.greatest(8 - known, F.lit(0))), F.coalesce(F.get(sides, F.lit(1)), F.array().cast("array<string>")))
        right = F.when(F.size(sides) == 2, known <= 7).otherwise((F.size(sides) == 1) & (known == 8))
        return F.when(right, filled)

    def shortest(g: Column) -> Column:
        text = F.array_join(F.transform(g, lambda x: F.regexp_replace(x, "^0+(?=.)", "")), ":")

        def cut(t: Column) -> Column:
            found = t
            for zeros in range(2, 9):
                run = rf"^((?:[^:]+:)*?)0(?::0){{{zeros - 1}}}((?::[^:]+)*)$"
                left, right = F.regexp_extract(t, run, 1), F.regexp_extract(t, run, 2)
                short = F.concat(F.when(left == "", ":").otherwise(left), F.when(right == "", ":").otherwise(right))
                found = F.when(t.rlike(run), short).otherwise(found)
            return found

        return F.when(F.forall(g, lambda x: x.rlike("^[0-9a-f]{1,4}$")), F.concat(F.lit("["), let(text, cut), F.lit("]")))

    return let(let(hexed, groups), shortest)


def written_host(host: Column) -> Column:
    numeric = r"(?:^|\.)(?:[0-9]+|0x[0-9a-f]*)\.?$"
    return F.when(host.startswith("["), ipv6(host)).otherwise(let(ascii_host(host), lambda h: F.when(h.rlike(numeric), ipv4(h)).otherwise(h)))


def written_path(path: Column) -> Column:
    """path with its steps of dots taken, escaped."""
    up, here = r"(?i)^(?:\.|%2e){2}$", r"(?i)^(?:\.|%2e)$"
    ended = F.when(path.rlike(r"(?i)/(?:\.|%2e){1,2}$"), F.concat(path, F.lit("/"))).otherwise(path)

    def step(taken: Column, segment: Column) -> Column:
        back = F.slice(taken, 1, F.greatest(F.size(taken) - 1, F.lit(0)))
        return F.when(segment.rlike(up), back).when(segment.rlike(here), taken).otherwise(F.array_append(taken, segment))

    walked = let(F.split(ended, "/"), lambda s: F.aggregate(F.slice(s, 2, F.size(s)), F.array().cast("array<string>"), step))
    whole = F.when(path.rlike(r"(?i)/(?:\.|%2e){1,2}(?:/|$)"), F.concat(F.lit("/"), F.array_join(walked, "/"))).otherwise(F.when(path == "", "/").otherwise(path))
    return let(whole, lambda w: escaped(w, IN_PATH))


def written_user(user: Column) -> Column:
    """name:password@ escaped, without what is empty; user is all before the last @."""
    name, password = F.regexp_extract(user, r"^[^:]*", 0), F.regexp_extract(user, r"(?s)^[^:]*:(.*)$", 1)
    secret = F.when(password == "", "").otherwise(F.concat(F.lit(":"), escaped(password, IN_USER)))
    return F.when((name == "") & (password == ""), "").otherwise(F.concat(escaped(name, IN_USER), secret, F.lit("@")))


def written_port(port: Column, scheme: Column) -> Column:
    """:port, empty for the default one; null over 65,535."""
    digits = F.ltrim(port, F.lit("0"))
    number = F.when(F.length(digits) <= 5, F.when(digits == "", 0).otherwise(digits.cast("int")))
    default = (port == "") | ((scheme == "http") & (number == 80)) | ((scheme == "https") & (number == 443))
    return F.when(default, "").when(number <= 65535, F.concat(F.lit(":"), number.cast("string")))


def parsed(url: Column) -> Column:
    """What `standard` gives, part by part."""

    def parts(u: Column) -> Column:
        take = lambda i: F.regexp_extract(u, PARTS, i)
        authority = take(2)
        host_port = F.regexp_extract(authority, r"(?s)^(?:.*@)?([^@]*)$", 1)
        fields = {
            "scheme": F.lower(take(1)),
            "user": F.regexp_extract(authority, r"(?s)^(.*)@", 1),
            "host": F.regexp_extract(host_port, r"(?s)^(\[[^\]]*\]|[^:]*)(?::[0-9]*)?$", 1),
            "port": F.regexp_extract(host_port, r"(?s):([0-9]*)$", 1),
            "path": take(3),
            "query": take(4),
            "fragment": take(5),
        }
        return F.when(u.rlike(PARTS), F.struct(*[c.alias(n) for n, c in fields.items()]))

    def written(p: Column) -> Column:
        port = F.when(p["host"].startswith("[") & p["port"].isNull(), "").otherwise(p["port"])
        return F.concat(
            p["scheme"],
            F.lit("://"),
            written_user(p["user"]),
            written_host(p["host"]),
            written_port(port, p["scheme"]),
            written_path(p["path"]),
            escaped(p["query"], IN_QUERY),
            escaped(p["fragment"], IN_FRAGMENT),
        )

    return let(let(cleaned(url), parts), written)


def is_plain(url: Column) -> Column:
    """Whether the standard changes nothing of url but the case of scheme and host, and an empty path."""
    return url.rlike(PLAIN) & ~url.rlike(r"(?i)^(?:http://[^/?#]*:80|https://[^/?#]*:443)(?:[/?#]|$)")


def plain_form(url: Column) -> Column:
    """A plain URL as the standard writes it, without the long way."""
    start, rest = F.regexp_extract(url, r"^[^/]*//[^/?#]*", 0), F.regexp_extract(url, r"^[^/]*//[^/?#]*(.*)$", 1)
    return F.concat(F.lower(start), F.when(rest.startswith("/"), "").otherwise("/"), rest)


def standard(url: Column) -> Column:
    """An absolute http(s) URL as the standard writes it, with its fragment; null for all else."""
    return F.when(is_plain(url), plain_form(url)).otherwise(parsed(url))
