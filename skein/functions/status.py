"""What came of a page load: result codes of two crawlers, HTTP statuses and archives in common categories."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Categories by code.
HTTP = {
    200: "ok", 301: "redirection loop", 302: "redirection loop", 303: "redirection loop", 307: "redirection loop", 308: "redirection loop", 400: "bad request (400)", 401: "authentication required (401)",
    403: "forbidden (403)", 404: "page not found (404/410)", 410: "page not found (404/410)", 500: "server error (500)", 503: "service unavailable (503)",
} | {c: "proxy error (502/504/52x)" for c in (502, 504, *range(520, 530))}
LEGAL = {451: "unavailable for legal reasons (451)"}
NETWORK_A = {
    "N1": "connection refused", "N2": "connection interrupted", "N3": "host not found", "N4": "timeout", "N5": "connection interrupted", "N6": "TLS handshake failed", "N101": "proxy failure", "N102": "proxy failure",
    "N103": "proxy failure", "N104": "proxy failure", "N105": "proxy failure", "N199": "proxy failure", "N205": "other network error", "N301": "invalid URL", "N302": "other network error", "N399": "other network error",
}
DETAIL_A = {"N99 Connection to proxy refused": "proxy failure", "N99 Host unreachable": "server unreachable", "N99 Network unreachable": "server unreachable", "N99 Unknown error": "other network error"}
NETWORK_B = {
    "dns-notfound": "host not found", "tcp-unreachable": "server unreachable", "tcp-refused": "connection refused", "tcp-reset": "connection interrupted", "tls-selfsigned": "TLS handshake failed",
    "tls-untrusted": "TLS handshake failed", "tls-invalid": "TLS handshake failed", "success": "crawler failure",
}
#: Statuses of the second crawler that its table lacks; used on request.
NETWORK_B_MORE = {"dns-error": "host not found", "tcp-error": "other network error", "tls-error": "TLS handshake failed", "timeout": "timeout"}
#: All details that the network probe reports.
PROBE_DETAILS = "success timeout dns-notfound dns-error tcp-unreachable tcp-refused tcp-reset tcp-error tls-selfsigned tls-untrusted tls-invalid tls-error".split()
SOURCE_GROUPS = {
    "Australia 2009 (ACMA; Wikileaks)": "leak", "Germany 2014 (#BPjMleak)": "leak", "India 2012 (Anonymous)": "leak", "India 2012 (Assam riots)": "leak", "Italy 2009 (Wikileaks)": "leak", "Norway 2009 (Wikileaks)": "leak",
    "Russia 2014 (rublacklist.net)": "leak", "Thailand 2007 (Wikileaks)": "leak", "UK 2015 (blocked.org.uk)": "leak", "Syria 2015 (Bluesmote/Telecomix)": "leak", "Turkey 2015 (Engelliweb)": "leak",
    "Denmark 2008 (Wikileaks)": "leak", "Finland 2009 (Wikileaks)": "leak", "Thailand 2008 (Wikileaks)": "leak", "Thailand 2009 (Wikileaks)": "leak", "CitizenLab 2014": "sensitive", "Herdict 2014": "sensitive",
    "Wikipedia controversies 2015": "sensitive", "Alexa 2014": "control", "Pinboard 2014": "control", "Tweets 2014": "control", "Twitter user profiles 2014": "control",
}


def lookup(values: dict, key: Column) -> Column:
    """A literal map as one expression; null where the key is not in it."""
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in values.items() for x in kv]), key)


def category_a(status: Column, detail: Column) -> Column:
    number = status.try_cast("int")
    other = F.when(status == "timeout", "timeout").when(status == "hostname not found", "host not found").otherwise("crawler failure")
    net = F.when(status == "N99", lookup(DETAIL_A, F.coalesce(detail, F.lit("")))).otherwise(lookup(NETWORK_A, status))
    http = F.coalesce(lookup(HTTP, number), F.lit("other HTTP response"))
    return F.when(status.startswith("N"), F.coalesce(net, F.lit("crawler failure"))).when(number.isNotNull(), http).otherwise(other)


def category_b(status: Column, more: bool = False) -> Column:
    number = status.try_cast("int")
    net = F.coalesce(lookup(NETWORK_B | (NETWORK_B_MORE if more else {}), status), F.lit("other network error"))
    return F.when(number.isNotNull(), F.coalesce(lookup(HTTP, number), F.lit("other HTTP response"))).otherwise(net)


def http_result(status: Column, reason: Column) -> Column:
    """struct(result, detail): coarse and fine."""
    coarse = F.coalesce(lookup(HTTP | LEGAL, status.cast("int")), F.lit("other HTTP response"))
    return F.struct(coarse.alias("result"), F.concat_ws(" ", status.cast("string"), reason).alias("detail"))


def archive_error(status: Column, body: Column, site: str = "web.archive.org") -> Column:
    """Whether the archive, not the archived site, made the page."""
    ascii_body = F.decode(F.encode(body, "ISO-8859-1"), "ISO-8859-1")
    return status.isin(403, 404, 429, 500, 502, 503, 504) & F.coalesce(ascii_body.contains(site), F.lit(False))


# What the sandbox writes before the fate of the crawler, fates that are timeouts, and fates that mean lack of memory.
SANDBOX = "isolate: phantomjs: "
TIMEOUTS = ["Alarm clock", "CPU time limit exceeded"]
MEMORY = ["Segmentation fault", "Killed"]


def stderr_result(text: Column) -> Column:
    """struct(status, detail, log) of what a crawler that failed wrote to stderr; log: the lines that say nothing of its fate.

    The last line that tells a fate decides; an abort keeps the detail of the line before it.
    """
    lines = F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: x != "")
    state = lambda status, detail: F.struct(status.alias("status"), detail.alias("detail"))
    failed, none = F.lit("crawler failure"), F.lit("")

    def step(acc: Column, line: Column) -> Column:
        fate = F.substr(line, F.lit(len(SANDBOX) + 1))
        detail = F.when(fate.isin(MEMORY), "out of memory").when((fate == "Aborted") & (acc["detail"] != ""), acc["detail"]).otherwise(fate)
        told = F.when(fate.isin(TIMEOUTS), state(F.lit("timeout"), fate)).otherwise(state(failed, detail))
        return F.when(line.startswith(SANDBOX), told).when(line.contains("bad_alloc"), state(failed, F.lit("out of memory"))).otherwise(acc)

    told = F.aggregate(lines, state(none, none), step, lambda acc: F.when(acc["status"] == "", state(failed, F.lit("unexplained unsuccessful exit"))).otherwise(acc))
    return F.struct(told["status"].alias("status"), told["detail"].alias("detail"), F.filter(lines, lambda x: ~(x.startswith(SANDBOX) | x.contains("bad_alloc"))).alias("log"))


def source_group(label: Column) -> Column:
    return lookup(SOURCE_GROUPS, label)


def plot_change(change: Column) -> Column:
    """Changes in the few kinds that are plotted."""
    return (
        F.when(change.isin("unchanged", "original"), "unchanged")
        .when(change == "parked", "parked")
        .when(change.isin("host not found", "dns error"), "dns error")
        .when(change.rlike("40[0-9]|410|451|50[0-9]|52|HTTP|forbidden|not found|redirection"), "http error")
        .otherwise("network error")
    )


def ip_number(ip: Column) -> Column:
    p = F.split(ip, r"\.")
    part = lambda i: F.try_element_at(p, F.lit(i + 1)).try_cast("long")
    return part(0) * 16777216 + part(1) * 65536 + part(2) * 256 + part(3)
