"""URL functions: canonical forms, joining, classes, domains. Plain Python kernels with Arrow adapters; native columns where a regex says it all."""

from __future__ import annotations

import mimetypes
import re
from collections.abc import Callable, Iterable
from functools import reduce
from html import unescape
from urllib.parse import SplitResult, quote, urlsplit
from urllib.robotparser import RobotFileParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Characters that stand for themselves in a URL: printable ASCII.
PRINTABLE = "".join(map(chr, range(0x21, 0x7F)))
_HEX = frozenset("0123456789abcdefABCDEF")


def begins_escape(after: str) -> bool:
    """Whether a percent sign with this text after it is an escape: two hexadecimal digits, or u and four."""
    return len(after) >= 2 and _HEX.issuperset(after[:2]) or len(after) >= 5 and after[0] == "u" and _HEX.issuperset(after[1:5])


def escape(part: str) -> str:
    """Percent-encode what is not printable ASCII, and percent signs that begin no escape."""
    first, *rest = part.split("%")
    return quote(first + "".join(("%" if begins_escape(x) else "%25") + x for x in rest), safe=PRINTABLE, errors="surrogateescape")


def split_canonical(url: str, lenient: bool = False) -> SplitResult:
    """The parts of the canonical form.

    Strict: http(s) only, with a valid host. Lenient: any scheme, hosts may be empty, and are encoded label by label.
    """
    slashes = r"(?i)^([a-z]+):/+" if lenient else r"(?i)^([a-z]+):///+"
    url = url.strip()
    parts = urlsplit(url)
    if not parts.hostname:
        parts = urlsplit(re.sub(slashes, r"\1://", url))
    host, port = parts.hostname or "", parts.port
    if not lenient:
        if not host:
            raise ValueError("no host")
        if parts.scheme not in ("http", "https"):
            raise ValueError("not http or https")
    if lenient:
        host = ".".join(x.encode("idna").decode("ascii") if x else "" for x in host.split("."))
    else:
        host = host.encode("idna").decode("ascii")
    if ":" in host:
        host = f"[{host}]"
    user, password = escape(parts.username or ""), escape(parts.password or "")
    auth = f"{user}:{password}@" if password else f"{user}@" if user else ""
    usual = {"http": 80, "https": 443}.get(parts.scheme)
    place = auth + host + ("" if port is None or port == usual else f":{port}")
    path = escape(parts.path) or ("/" if host else "")
    return SplitResult(parts.scheme, place, path, escape(parts.query), escape(parts.fragment))


def canon_url(url: str | None, lenient: bool = False) -> str | None:
    """The canonical form, None where there is none."""
    return canon_or_reason(url, lenient)[0]


def canon_or_reason(url: str | None, lenient: bool = False) -> tuple[str | None, str | None]:
    if url is None:
        return None, None
    try:
        return split_canonical(url, lenient).geturl(), None
    except (ValueError, UnicodeError) as e:
        return None, str(e) or type(e).__name__


def pandas_map(fn: Callable, kind: str):
    """An Arrow UDF that applies fn to each value."""

    def apply(s: pd.Series) -> pd.Series:
        return s.map(fn)

    apply.__annotations__ = {"s": pd.Series, "return": pd.Series}
    return F.pandas_udf(apply, kind)


def pandas_map2(fn: Callable, kind: str):
    def apply(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([fn(x, y) for x, y in zip(a, b)], dtype=object)

    apply.__annotations__ = {"a": pd.Series, "b": pd.Series, "return": pd.Series}
    return F.pandas_udf(apply, kind)


def canonical(url: Column, lenient: bool = False) -> Column:
    """The canonical URL, null where there is none."""
    return pandas_map(lambda u: canon_url(u, lenient), "string")(url)


def canonical_with_reason(url: Column, lenient: bool = False) -> Column:
    def both(s: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([canon_or_reason(u, lenient) for u in s], columns=["url", "reason"])

    both.__annotations__ = {"s": pd.Series, "return": pd.DataFrame}
    return F.pandas_udf(both, "url string, reason string")(url)


# Sites


NO_WWW = re.compile(r"^(?:\d+\.\d+\.\d+\.\d+$|\[[\dA-Fa-f:]+\]$|www\.)")


def site_urls(site: str, http_only: bool = False, www_only: bool = False) -> list[str]:
    """URLs that a bare site (with or without a path) may stand for: with and without www, path and TLS."""
    own = split_canonical(f"http://{site}")
    hosts = [own.netloc]
    if not NO_WWW.match(own.hostname or ""):
        auth, at, place = own.netloc.rpartition("@")
        hosts = [f"{auth}{at}www.{place}"] + ([] if www_only else [own.netloc])
    paths = ["/"] + ([own.path] if own.path != "/" else [])
    schemes = ["http"] if http_only else ["http", "https"]
    return [SplitResult(s, h, p, own.query, own.fragment).geturl() for p in paths for h in hosts for s in schemes]


def expand_sites(df: DataFrame, site: str, http_only: bool = False, www_only: bool = False) -> DataFrame:
    def safe(s: str | None) -> list[str]:
        try:
            return site_urls(s or "", http_only, www_only)
        except (ValueError, UnicodeError):
            return []

    return df.withColumn("url", F.explode(pandas_map(safe, "array<string>")(F.col(site))))


def precanonical(url: Column) -> Column:
    """http:// in front where there is no scheme; a bare host gets a path."""
    u = F.trim(url)
    u = F.when(u.rlike(r"(?i)^[a-z][a-z0-9+.-]*://"), u).otherwise(F.concat(F.lit("http://"), u))
    return F.when(u.rlike(r"^[^/]+//[^/?#]+$"), F.concat(u, F.lit("/"))).otherwise(u)


def postcanonical(url: Column) -> Column:
    """Without fragment, and without the slash at the end of a path that is more than the root."""
    return F.regexp_replace(F.regexp_replace(url, "#.*$", ""), r"^([a-z]+://[^/?#]+/[^?#]+?)/+$", "$1")


def is_siteroot(url: Column) -> Column:
    return url.rlike(r"(?i)^https?://[^/?#]+/?$")


# Joining, by the rules that came before RFC 3986


# Schemes with relative references, with hosts, and with parameters.
RELATIVE = frozenset("ftp gopher http https imap mms nntp prospero rtsp rtspu sftp shttp svn svn+ssh wais file".split()) | {""}
HOSTED = RELATIVE | frozenset("git git+ssh rsync snews telnet".split())
PARAMS = frozenset("ftp hdl http https imap mms prospero rtsp rtspu sftp shttp sip sips tel".split()) | {""}
_SCHEME = re.compile(r"([A-Za-z0-9+.\-]+):(?![0-9]+$)(.*)", re.S)


def _parse(url: str, scheme: str = "") -> list[str]:
    if m := _SCHEME.fullmatch(url):
        scheme, url = m[1].lower(), m[2]
    host = ""
    if url.startswith("//"):
        end = min((i for c in "/?#" if (i := url.find(c, 2)) >= 0), default=len(url))
        host, url = url[2:end], url[end:]
    url, _, fragment = url.rpartition("#") if "#" in url else (url, "", "")
    url, _, query = url.rpartition("?") if "?" in url else (url, "", "")
    params = ""
    if scheme in PARAMS and (i := url.find(";", url.rfind("/") + 1)) >= 0:
        url, params = url[:i], url[i + 1 :]
    return [scheme, host, url, params, query, fragment]


def _unparse(scheme: str, host: str, path: str, params: str, query: str, fragment: str) -> str:
    if host or scheme in HOSTED and scheme and not path.startswith("//"):
        path = "//" + host + (path if path.startswith("/") else "/" + path)
    out = f"{scheme}:{path}" if scheme else path
    return out + (f";{params}" if params else "") + (f"?{query}" if query else "") + (f"#{fragment}" if fragment else "")


def urljoin(base: str, url: str) -> str:
    """url as seen from base; ``..`` above the root stays."""
    if not base or not url:
        return _unparse(*_parse(url or base))
    b, u = _parse(base), _parse(url, _parse(base)[0])
    if u[0] != b[0] or u[0] not in RELATIVE or u[0] in HOSTED and u[1]:
        return _unparse(*u)
    host = b[1] if u[0] in HOSTED else u[1]
    if u[2].startswith("/"):
        return _unparse(u[0], host, *u[2:])
    if not u[2] and not u[3]:
        return _unparse(u[0], host, b[2], b[3], u[4] or b[4], u[5])
    steps = b[2].split("/")[:-1] + u[2].split("/")
    if steps[-1] == ".":
        steps[-1] = ""
    steps = [s for s in steps if s != "."]
    i = 1
    while i < len(steps) - 1:
        if steps[i] == ".." and steps[i - 1] not in ("", ".."):
            del steps[i - 1 : i + 1]
            i = 1
        else:
            i += 1
    if steps == ["", ".."]:
        steps = ["", ""]
    elif len(steps) >= 2 and steps[-1] == "..":
        steps[-2:] = [""]
    return _unparse(u[0], host, "/".join(steps), *u[3:])


def urljoin_outbound(page: str, url: str) -> str | None:
    """urljoin(), None for a link into the page itself."""
    to = urljoin(page, url)
    plain = lambda x: x.rpartition("#")[0] if "#" in x else x
    return None if plain(to) == plain(page) else to


def outbound(page: str, urls: Iterable[str]) -> list[str]:
    """Absolute, distinct, sorted URLs other than the page itself."""
    return sorted({to for u in urls if (to := urljoin_outbound(page, u)) is not None})


# Classes


# Extensions of pages, plain texts and office documents.
HTML_EXT = "asp aspx atom cfm cgi do htm html jsp mml php php3 php3p php4 php5 phps pht phtm phtml rdf rht rhtm rhtml sht shtm shtml xht xhtm xhtml".split()
TEXT_EXT = "asc bib brf latex ltx lyx man markdown md me ms pot roff rtx srt t tex texi texinfo text tm tr txt".split()
DOC_EXT = (
    "abw ai book doc docm docx dot dotm dotx dvi eps eps2 eps3 epsf epsi fb fbdoc fm frame frm gnumeric kpr kpt ksp kwd kwt maker nb nbp odb odc odf odg odi odm odp ods odt otg oth otp ots ott pdf "
    "potm potx ppam pps ppsm ppsx ppt pptm pptx ps rtf sda sdc sdd sds sdw sgl sldm sldx stc std sti stw sxc sxd sxg sxi sxm sxw wp5 wpd xlam xlb xls xlsb xlsm xlsx xlt xltm xltx"
).split()
# Some hosts that shorten URLs; pass a longer list as a parameter.
SHORTENERS = (
    "adf.ly adjix.com alturl.com bc.vc bit.do bit.ly bitly.com budurl.com buk.me clck.ru cli.gs cort.as cutt.us db.tt dft.ba doiop.com eepurl.com ff.im fb.me flic.kr gg.gg goo.gl goshrink.com hex.io "
    "ht.ly hurl.it hurl.me hurl.ws icanhaz.com idek.net is.gd ity.im j.mp kl.am korta.nu lnk.gd lnkd.in lt.tl mcaf.ee metamark.net migre.me minilien.com miniurl.com moourl.com myurl.in notlong.com "
    "om.ly ow.ly pic.gd ping.fm post.ly q.gs qr.ae qr.net ri.ms rubyurl.com shorl.com short.ie short.to shorturl.com shrinkify.com sn.im snipr.com snipurl.com snurl.com su.pr t.co tcrn.ch tiny.cc "
    "tiny.pl tinyarro.ws tinyuri.ca tinyurl.com to.ly tr.im tweez.me twitthis.com twurl.cc twurl.nl u.nu u.to url.ie urlcut.com urlx.ie v.gd viralurl.com vur.me wp.me x.co xr.com xrl.in xrl.us xurl.jp "
    "yep.it yfrog.com youtu.be zi.ma zz.gd"
).split()


def data_extensions() -> list[str]:
    """Extensions of other files: all that the standard MIME table knows and the lists above do not."""
    known = {e.lstrip(".").lower() for e in mimetypes.MimeTypes().types_map[True]} | {"exe", "rar", "7z", "gz", "iso", "flv", "mkv", "torrent", "json", "apk"}
    return sorted(known.difference(HTML_EXT, TEXT_EXT, DOC_EXT))


def _any(words: Iterable[str]) -> str:
    return "(?:" + "|".join(map(re.escape, sorted(words, key=lambda w: (-len(w), w)))) + ")"


def class_patterns(shorteners: Iterable[str] = SHORTENERS) -> list[tuple[str, str]]:
    """(class, pattern) in the order in which they are tried; patterns read alike in Python, Java and RE2."""
    of = lambda words: r"(?i)/[^/?;#]+?\." + _any(words) + r"(?:$|[?;#])"
    return [
        ("short", r"(?i)(?:\.|//)" + _any(shorteners) + r"(?:$|[/?;#])"),
        ("noext", r"(?i)/[^/?;#.]*(?:$|[?#;])"),
        ("html", of(HTML_EXT)),
        ("text", of(TEXT_EXT)),
        ("doc", of(DOC_EXT)),
        ("data", of(data_extensions())),
    ]


def url_class(url: Column, shorteners: Iterable[str] = SHORTENERS) -> Column:
    """non-http, short, noext, html, text, doc, data or unknown; the first that holds."""
    out = F.when(~url.rlike("(?i)^https?://"), "non-http")
    return reduce(lambda c, kp: c.when(url.rlike(kp[1]), kp[0]), class_patterns(shorteners), out).otherwise("unknown")


RESOURCE_EXT = "css js png jpg jpeg gif ico bmp swf flv mp3 mp4 avi wmv woff ttf svg xml json zip rar exe".split()


def is_resource(url: Column, extensions: Iterable[str] = RESOURCE_EXT) -> Column:
    return url.rlike(r"(?i)\." + _any(extensions) + r"(?:$|[?#;])")


# Domains


def domain(url: Column) -> Column:
    """Host without scheme, path, port, backslash and last dot."""
    return F.regexp_replace(F.regexp_extract(url, r"^[^:]*://([^/:\\]*)", 1), r"\.$", "")


def is_ip(host: Column) -> Column:
    octet = "(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|0*[0-9]{1,2})"
    return host.rlike(rf"^(?:{octet}\.){{3}}{octet}$")


# Public suffixes of two labels for when no list is given.
SUFFIXES = "co.uk org.uk ac.uk gov.uk com.au net.au org.au co.nz co.jp ne.jp or.jp ac.jp com.br com.cn net.cn org.cn gov.cn co.in co.kr com.tr com.mx com.ar co.za com.sa com.eg com.pk com.sg com.hk com.tw".split()


def read_suffixes(lines: Iterable[str]) -> frozenset[str]:
    """Rules of a public-suffix list, up to the end of the ICANN part."""
    out = set()
    for line in lines:
        if "===END ICANN DOMAINS===" in line:
            break
        if (rule := line.split("//")[0].strip()) and not line.startswith("//"):
            out.add(rule.lower())
    return frozenset(out)


def registered_domain(host: str | None, suffixes: frozenset[str] = frozenset(SUFFIXES)) -> str | None:
    """The label before the public suffix and the suffix; None for a suffix itself. ``*`` and ``!`` rules hold; an unknown top label is a suffix."""
    labels = (host or "").lower().rstrip(".").split(".")
    size = 1
    for k in range(1, len(labels) + 1):
        tail = ".".join(labels[-k:])
        if f"!{tail}" in suffixes:
            size = k - 1
            break
        if tail in suffixes or k > 1 and f"*.{'.'.join(labels[-k + 1:])}" in suffixes:
            size = k
    return ".".join(labels[-size - 1 :]) if len(labels) > size and all(labels) else None


def crosses_domain(url: Column, redirect: Column, suffixes: frozenset[str] = frozenset(SUFFIXES)) -> Column:
    """1 if a redirect leaves the registered domain; 0 without one, and from or to an address."""
    a, b = domain(url), domain(redirect)
    reg = pandas_map(lambda h: registered_domain(h, suffixes), "string")
    return F.when(redirect.isNull() | (redirect == "") | is_ip(a) | is_ip(b), 0).when(reg(a).eqNullSafe(reg(b)), 0).otherwise(1)


# URLs in text


# Top labels besides those of two letters that mark a bare domain; pass a full list as a parameter.
TOP = (
    "com org net edu gov mil int info biz name pro aero coop museum jobs mobi travel tel cat asia post xxx arpa app dev page blog shop site online store tech space website club xyz top live news media "
    "world today life email cloud agency company center city digital directory design art wiki work works zone academy guru expert photos photo gallery video tube link click help support team network systems"
).split()


# The pattern of a URL in running text, whole; TLD stands for the top labels.
URL_IN_TEXT = r"""
\b
(
  (?:
    https?:(?:/{1,3}|[a-z0-9%])
    | [a-z0-9.\-]+[.](?:TLD)/
  )
  (?:
    [^\s()<>{}\[\]]+
    | \([^\s()]*?\([^\s()]+\)[^\s()]*?\)
    | \([^\s]+?\)
  )+
  (?:
    \([^\s()]*?\([^\s()]+\)[^\s()]*?\)
    | \([^\s]+?\)
    | [^\s`!()\[\]{};:'".,<>?«»“”‘’]
  )
  | (?:
    (?<!@)
    [a-z0-9]+(?:[.\-][a-z0-9]+)*[.](?:TLD)\b/?
    (?!@)
  )
)
"""


def url_in_text_pattern(top: Iterable[str] = TOP) -> re.Pattern:
    return re.compile(URL_IN_TEXT.replace("TLD", "[a-z]{2}|xn--[a-z0-9-]+|" + "|".join(sorted(top))), re.VERBOSE | re.IGNORECASE)


_URL = url_in_text_pattern()


def url_at_start(text: str | None) -> str | None:
    m = _URL.match(text or "")
    return m[1] if m else None


# Archives, robots, redirects


ARCHIVE = "https://web.archive.org"


def archive_target(location: str, base: str = ARCHIVE) -> tuple[str, str]:
    """('archived', url) for a redirect inside the archive, ('live', url) for one that has to be looked up again."""
    if location.startswith("/web/"):
        return "archived", base + location
    bare = re.sub(r"^https?://", "", location)
    if bare.startswith(re.sub(r"^https?://", "", base) + "/web/"):
        return "archived", location
    return "live", location


def robots_site(url: Column) -> Column:
    return F.concat(F.regexp_extract(url, r"^([a-zA-Z]+://[^/?#]+)", 1), F.lit("/robots.txt"))


def robots_rules(text: str | None) -> RobotFileParser:
    parser = RobotFileParser()
    parser.parse((text or "").splitlines())
    return parser


def allowed(urls: DataFrame, robots: DataFrame, agent: str = "*") -> DataFrame:
    """urls (url) that robots (site, body) do not forbid, with crawl_delay (1 if none is set). Sites without rules allow all."""

    def judge(a: pd.Series, b: pd.Series) -> pd.DataFrame:
        seen: dict[str, RobotFileParser] = {}
        rows = []
        for url, body in zip(a, b):
            r = seen.setdefault(body or "", robots_rules(body))
            rows.append((r.can_fetch(agent, url), float(r.crawl_delay(agent) or 1)))
        return pd.DataFrame(rows, columns=["ok", "delay"])

    judge.__annotations__ = {"a": pd.Series, "b": pd.Series, "return": pd.DataFrame}
    udf = F.pandas_udf(judge, "ok boolean, delay double")
    own = urls.withColumn("site", robots_site(F.col("url"))).join(robots.select("site", "body"), "site", "left").withColumn("r", udf("url", "body"))
    return own.filter("r.ok").withColumn("crawl_delay", F.col("r.delay")).drop("r", "body")


def wiki_url(lang: Column, title: Column) -> Column:
    return F.concat(F.lit("https://"), lang, F.lit(".wikipedia.org/wiki/"), F.replace(title, F.lit(" "), F.lit("_")))


def in_chain(url: Column, chain: Column) -> Column:
    """Whether a redirect chain holds the URL, but for a slash at the end."""
    bare = lambda c: F.regexp_replace(c, "/+$", "")
    return F.exists(chain, lambda x: bare(x) == bare(url))


def page_targets(base: str, html: str) -> tuple[str | None, str | None]:
    """(target of a meta refresh, canonical link) of a page, absolute; None where it has none. A refresh without a URL is none."""
    refresh = canonical = None
    for tag in re.findall(r"(?is)<(?:meta|link)\b[^>]*>", html or ""):
        own = {k.lower(): unescape(v.strip("\"'")) for k, v in re.findall(r"""(?s)([\w-]+)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", tag)}
        if own.get("http-equiv", "").lower() == "refresh" and refresh is None:
            _, _, rest = own.get("content", "").partition(";")
            name, _, to = rest.strip().partition("=")
            if name.strip().lower() == "url" and to.strip(" \"'"):
                refresh = urljoin(base, to.strip(" \"'"))
        elif "canonical" in own.get("rel", "").lower().split() and own.get("href") and canonical is None:
            canonical = urljoin(base, own["href"].strip())
    return refresh, canonical


def targets(url: Column, html: Column) -> Column:
    """struct(refresh, canonical) of a page."""

    def both(a: pd.Series, b: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([page_targets(u or "", h or "") for u, h in zip(a, b)], columns=["refresh", "canonical"])

    both.__annotations__ = {"a": pd.Series, "b": pd.Series, "return": pd.DataFrame}
    return F.pandas_udf(both, "refresh string, canonical string")(url, html)


def final_status(entries: list[dict], start: str) -> tuple[str, int | None]:
    """(last URL, status) after following redirectURL through HAR entries from start; a loop ends where it closes."""
    by = {e["request"]["url"]: e["response"] for e in reversed(entries)}
    url, seen = start, set()
    while url in by and url not in seen:
        seen.add(url)
        to = by[url].get("redirectURL")
        if not to:
            return url, by[url].get("status")
        url = urljoin(url, to)
    return url, by.get(url, {}).get("status")


def dns_name(name: str | None) -> str | None:
    """The name in ASCII if it can be one in the DNS."""
    try:
        out = (name or "").strip().rstrip(".").encode("idna").decode("ascii").lower()
    except UnicodeError:
        return None
    ok = out and len(out) < 254 and all(re.fullmatch(r"(?!-)[a-z0-9_-]{1,63}(?<!-)", x) for x in out.split("."))
    return out if ok else None
