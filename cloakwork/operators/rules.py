"""Rules as data. A rule says which spans of a match stand for an identity (`Field`s); one resolver turns fields into tokens."""

from __future__ import annotations

import ipaddress
import re
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field, replace

from ..functions import grammar as g
from .ledger import Ledger, host_tokens, is_typed


@dataclass
class Field:
    """A span of a text that stands for an identity."""

    start: int
    end: int
    value: str
    category: str
    template: str
    key: str | None = None
    skip_tokens: str = "typed"  # leave the span if its text is a token: "typed" or known, "known" only, or "never"
    alias: bool = False  # a short host name: shares the number of the one known host with that first label
    before: str = ""  # kept in front of the token, part of what the whole span stands for
    after: str = ""  # likewise behind it
    whole: str | None = None  # what the span with `before` and `after` is registered as
    any_case: bool = False  # an equal key in another case is the same
    taken: Callable[[int], bool] = lambda n: False


@dataclass(frozen=True)
class Rule:
    name: str
    category: str
    priority: int
    pattern: str
    template: str
    fields: Callable[[Rule, re.Match, Ledger], list[Field] | None]
    key: Callable[[str], str] | None = None
    valid: Callable[[str], bool] | None = None
    enabled: bool = True
    gate: tuple[str, ...] = ()
    only: frozenset[str] | None = None
    group: int | str = 0  # the part of a match that `valid` and `only` look at
    compiled: re.Pattern = field(default=None, compare=False)  # type: ignore[assignment]

    def __post_init__(self):
        if self.compiled is None:
            object.__setattr__(self, "compiled", re.compile(self.pattern))

    def field_of(self, m: re.Match, group, **kw) -> Field:
        value = m[group]
        return Field(m.start(group), m.end(group), value, self.category, self.template, self.key(value) if self.key else value, **kw)


# --- identity keys and validators ------------------------------------------------------------------------------------


def ipv6_key(value: str) -> str:
    address, mark, zone = value.partition("%")
    return ipaddress.IPv6Address(address).compressed.casefold() + mark + zone


def mac_key(value: str) -> str:
    return value.translate({ord(c): None for c in ":.-"}).casefold()


def luhn(value: str) -> bool:
    digits = [int(c) for c in value if c.isdigit()][::-1]
    return len(digits) >= 13 and (sum(digits[::2]) + sum(sum(divmod(2 * d, 10)) for d in digits[1::2])) % 10 == 0


def plain_ipv4(value: str) -> bool:
    return value not in g.SKIP_IPV4 and not value.startswith(g.SKIP_IPV4_PREFIXES)


def real_account(value: str) -> bool:
    domain, mark, rest = value.partition("\\")
    domain, user = domain.upper(), rest.split(":")[0].upper()
    return not mark or not (domain in g.SKIP_DOMAINS or user in g.SKIP_USERS or domain.startswith(g.SKIP_DOMAIN_STARTS))


def line_at(text: str, place: int) -> str:
    end = text.find("\n", place)
    return text[text.rfind("\n", 0, place) + 1 : len(text) if end < 0 else end]


def is_port_list(value: str) -> bool:
    if not re.fullmatch(g.PORT_SPEC, value):
        return False
    return all(int(p) <= 65535 for p in re.findall(r"\d+", value))


# --- which spans of a match stand for what ---------------------------------------------------------------------------


def whole_match(rule: Rule, m: re.Match, ledger: Ledger) -> list[Field]:
    return [rule.field_of(m, 0)]


def named_value(rule: Rule, m: re.Match, ledger: Ledger) -> list[Field]:
    return [rule.field_of(m, "value")]


def secret_value(rule: Rule, m: re.Match, ledger: Ledger) -> list[Field] | None:
    value = m["value"]
    # a token's own closing bracket may be what ended the match
    cut_token = value.startswith("[") and m.string[m.end() : m.end() + 1] == "]" and is_typed(value + "]")
    return None if not value or value.casefold() in g.SAFE_LITERALS or cut_token else [rule.field_of(m, "value")]


def two_kinds(first: str, second: str, first_category: str):
    """Two spans of one match: the first of another category than the rule's own."""

    def fields(rule: Rule, m: re.Match, ledger: Ledger) -> list[Field]:
        a = Field(m.start(first), m.end(first), m[first], first_category, g.TEMPLATES[first_category], m[first])
        return [a, rule.field_of(m, second)]

    return fields


def hash_half(rule: Rule, m: re.Match, ledger: Ledger) -> list[Field]:
    return [rule.field_of(m, "hash", skip_tokens="never")]


def flag_value(rule: Rule, m: re.Match, ledger: Ledger) -> list[Field] | None:
    flag = m["flag"]
    group = next(x for x in ("double", "single", "plain") if m[x] is not None)
    value = m[group]
    if re.match(g.CLI_SKIP, value):
        return None
    if flag == "-U" and "%" in value and all(ledger.is_token(x) for x in value.split("%", 1)):
        return None
    if flag in g.HASH_FLAGS and all(not x or ledger.is_token(x) for x in value.split(":")):
        return None
    if flag == "-p" and is_port_list(value) and any(t in line_at(m.string, m.start()).lower() for t in g.PORT_SCANNERS):
        return None
    f = rule.field_of(m, group)
    if flag in g.USER_FLAGS:  # a name, not a credential
        f.category, f.template = "ad_domain_user", g.TEMPLATES["ad_domain_user"]
    return [f]


def url_value(rule: Rule, m: re.Match, ledger: Ledger) -> list[Field] | None:
    if m[0] in g.SCANNER_URLS and line_at(m.string, m.start()).startswith(g.SCANNER_LINES):
        return None
    return [rule.field_of(m, 0, skip_tokens="known")]


def network(rule: Rule, m: re.Match, ledger: Ledger) -> list[Field]:
    """The mask stays readable outside of the number, which is unique over all masks."""
    used = re.compile(r"\[CIDR_REDACTED_(\d+)\](?:/\d{1,3})?").fullmatch
    f = rule.field_of(m, 0, skip_tokens="known")
    f.template = rule.template.replace("{mask}", m[0].rpartition("/")[2])
    if f.value not in ledger.token_of:
        numbers = {int(x[1]) for t in ledger.known if (x := used(t))}
        f.taken = numbers.__contains__
    return [f]


def domain_value(rule: Rule, m: re.Match, ledger: Ledger) -> list[Field]:
    """`Domain: x`: a full domain name is a domain, anything else a secret; punctuation and digits that scanners add stay."""
    raw = m["value"]
    trimmed = raw.rstrip(".,;:!?)]}")
    name = re.fullmatch(f"({g.FQDN})(\\d*)".replace("(?i)", ""), trimmed.rstrip("."), re.I)
    if name:
        core = name[1]
    else:
        core = re.sub(r"(?i)(\.[a-z]{2,63})\d+$", r"\1", trimmed).rstrip(".")
    after = raw[len(core) :] if name else raw[len(trimmed) :]
    f = rule.field_of(m, "value", after=after, whole=raw if after else None)
    if re.fullmatch(g.FQDN, core):
        f.category, f.template, f.key = "domain", g.TEMPLATES["domain"], core.casefold()
    else:
        f.key = core
    return [f]


def short_host(rule: Rule, m: re.Match, ledger: Ledger) -> list[Field]:
    f = rule.field_of(m, "value", skip_tokens="known", alias=True)
    f.key = f.value.casefold()
    return [f]


def domain_chain(rule: Rule, m: re.Match, ledger: Ledger) -> list[Field]:
    """DC=a,DC=b shares the identity of a.b."""
    f = rule.field_of(m, "value", skip_tokens="known", before="DC=", whole=m["value"], any_case=True)
    f.key = ".".join(re.findall(r"(?i)DC=([a-zA-Z0-9-]+)", f.value)).casefold()
    return [f]


_FIELDS = {
    "impacket_hashes": hash_half, "nthash_plaintext": two_kinds("hash", "plaintext", "ntlm_hash"), "domain_context": domain_value, "context_secret": secret_value, "prose_secret": secret_value,
    "smb_user_pass": two_kinds("user", "pass", "ad_domain_user"), "cli_flag_secret": flag_value, "url": url_value, "cidr": network, "rdns_single_label": short_host, "smb_netbios_name": short_host, "ldap_dn_domain": domain_chain,
}
_KEYS = {"ipv6": ipv6_key, "mac": mac_key, "hostname_internal": str.casefold}
_VALID = {"credit_card": luhn, "ad_domain_user": real_account, "ipv4": plain_ipv4}


def built_in() -> list[Rule]:
    """All rules in the order in which they run."""
    found = []
    for name, priority, category in g.RULE_ORDER:
        pattern = g.PATTERNS[name]
        template = g.TEMPLATES["hostname_short" if name in g.SHORT_HOST_RULES else category]
        fields = _FIELDS.get(name, named_value if "(?P<value>" in pattern else whole_match)
        found.append(Rule(name, category, priority, pattern, template, fields, _KEYS.get(name), _VALID.get(name), name not in g.OFF_BY_DEFAULT, g.GATES.get(name, ())))
    return found


# --- rules that come with a run --------------------------------------------------------------------------------------


def _checked(values: Iterable[str], what: str) -> list[str]:
    values = list(values)
    if not all(isinstance(v, str) and v.strip() for v in values):
        raise ValueError(f"{what} must be non-empty strings")
    return values


def custom_values(values: Iterable[str], case_sensitive: bool = True) -> list[Rule]:
    """Literals, found inside words too."""
    return [Rule(f"custom_value_{v[:20]}", "custom", 50, ("" if case_sensitive else "(?i)") + re.escape(v), g.TEMPLATES["custom"], whole_match, None if case_sensitive else str.casefold) for v in _checked(values, "custom values")]


def custom_pattern(name: str, pattern: str, template: str = g.TEMPLATES["custom"]) -> Rule:
    _checked([name, pattern, template], "name, pattern and template")
    if re.compile(pattern).search("") is not None:
        raise ValueError("a custom pattern must not match empty text")
    try:
        same = template.format(n=1) == template.format(n=2)
    except (KeyError, IndexError, ValueError) as e:
        raise ValueError(f"invalid token template: {e}") from e
    if same:
        raise ValueError("a token template must vary with {n}")
    return Rule(name, "custom", 50, pattern, template, whole_match)


def target_domains(domains: Iterable[str]) -> list[Rule]:
    """A domain and all its subdomains."""
    label = r"[a-zA-Z0-9](?:[a-zA-Z0-9-]{0,61}[a-zA-Z0-9])?"
    return [Rule(f"target_{d}", "hostname", 44, rf"(?i)(?<![.\w])(?:{label}\.)*{re.escape(d)}(?![.\w])", g.TEMPLATES["hostname"], whole_match, str.casefold) for d in _checked(domains, "target domains")]


#: kind -> category, template, priority
TARGET_KINDS = {"hostname": ("hostname", "hostname_short", 44), "username": ("ad_domain_user", "ad_domain_user", 45), "netbios": ("domain", "domain", 45), "share": ("share", "share", 45)}


def targets(kind: str, values: Iterable[str]) -> list[Rule]:
    """Known names of an engagement, in any case; a dot beside one ends it only where no label goes on."""
    if kind == "domain":
        return target_domains(values)
    if kind not in TARGET_KINDS:
        raise ValueError(f"unknown target kind: {kind}")
    category, template, priority = TARGET_KINDS[kind]
    fields = short_host if kind == "hostname" else named_value
    return [Rule(f"target_{kind}_{v}", category, priority, rf"(?i)(?<!\w)(?<!\w\.)(?P<value>{re.escape(v)})(?!\w)(?!\.\w)", g.TEMPLATES[template], fields, str.casefold) for v in _checked(values, f"target {kind}")]


def in_order(rules: Iterable[Rule]) -> list[Rule]:
    return sorted(rules, key=lambda r: r.priority)


def switched(rules: list[Rule], on: Iterable[str] = (), off: Iterable[str] = ()) -> list[Rule]:
    names = {r.name for r in rules}
    if unknown := (set(on) | set(off)) - names:
        raise ValueError(f"unknown rule: {', '.join(sorted(unknown))}")
    on, off = set(on), set(off)
    return [replace(r, enabled=(r.enabled or r.name in on) and r.name not in off) for r in rules]


# --- the resolver ----------------------------------------------------------------------------------------------------


def known_host(label: str, ledger: Ledger) -> str | None:
    """The short form of the one host token whose name begins with this label."""
    wanted = label.casefold()
    found = {t for k, t in ledger.token_of.items() if "." in k and k.partition(".")[0].casefold() == wanted and host_tokens.fullmatch(t)}
    if len(found) != 1:
        return None
    token = found.pop()
    if token.startswith("[HOST_REDACTED_"):
        return "[HOST_SHORT" + token[len("[HOST") :]
    return token.removesuffix(".example.internal")


def resolve(f: Field, ledger: Ledger) -> str | None:
    """What goes in the field's place, None if it stays."""
    if f.skip_tokens != "never" and ledger.is_token(f.value, f.skip_tokens == "typed"):
        return None
    key = f.value if f.key is None else f.key
    token = None
    if f.alias and (token := known_host(f.value, ledger)):
        ledger.hold(key, token)
    if token is None:
        token = ledger.token_of.get(key)
    if token is None and f.any_case:
        token = next((t for k, t in ledger.token_of.items() if k.casefold() == key), None)
    if token is None:
        token = ledger.allocate(key, f.category, f.template, f.taken)
    elif token == key and not f.whole:
        return None
    shown = f.before + token + f.after
    if f.whole:
        if shown == f.value:
            return None
        ledger.token_of.setdefault(f.whole, shown)
        ledger.known.add(shown)
    return shown


def apply_rule(rule: Rule, text: str, ledger: Ledger, log: list[tuple[str, str, str]]) -> str:
    """The text with this rule's matches resolved from left to right; what was replaced is added to the log."""
    out, place = [], 0
    for m in rule.compiled.finditer(text):
        value = m[rule.group]
        if rule.only is not None and value not in rule.only or rule.valid is not None and not rule.valid(value):
            continue
        for f in rule.fields(rule, m, ledger) or ():
            token = resolve(f, ledger)
            if token is not None and token != f.value:
                log.append((f.category, f.value, token))
                out += [text[place : f.start], token]
                place = f.end
    return "".join(out) + text[place:] if out else text
