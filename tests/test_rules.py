"""The rules, kernels and passes on single texts."""

from __future__ import annotations

import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from cloakwork import Ledger, Policy, desanitize, redact_text, restore_text, sanitize
from cloakwork.functions import grammar as g
from cloakwork.functions.dialect import group_number, to_java
from cloakwork.operators import rules as R
from cloakwork.operators.redact import unfold
from cloakwork.operators.restore import unresolved


def redacted(text, policy=None):
    p = policy or Policy()
    return redact_text(text, p, p.ledger())[0]


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("password=10.10.14.5", "password=[SECRET_REDACTED_0001]"),
        ("Host 192.168.1.1", "Host [IPV4_REDACTED_0001]"),
        ("10.42.0.15 and 10.42.0.15", "[IPV4_REDACTED_0001] and [IPV4_REDACTED_0001]"),
        ("smbclient -U admin%P@ssword1 //server/share", "smbclient -U DOMAIN_USER_01%[SECRET_REDACTED_0001] //server/share"),
        ("[CIDR_REDACTED_0001]/24 and 10.23.0.0/16", "[CIDR_REDACTED_0001]/24 and [CIDR_REDACTED_0002]/16"),
        ("HOST_01.example.internal and dc01.corp.local", "HOST_01.example.internal and [HOST_REDACTED_0002]"),
        ("2001:DB8::1 2001:0db8:0:0:0:0:0:1", "[IPV6_REDACTED_0001] [IPV6_REDACTED_0001]"),
        ("00:11:22:aa:bb:cc 00-11-22-AA-BB-CC 0011.22aa.bbcc", "[MAC_REDACTED_0001] [MAC_REDACTED_0001] [MAC_REDACTED_0001]"),
        ("(Domain: sevenkingdoms.local0., Site: x)", "(Domain: [DOMAIN_REDACTED_0001]0., Site: x)"),
        ("-----BEGIN RSA PRIVATE KEY-----\nabc", "PRIVATE_KEY_REDACTED_01"),
        ("-----BEGIN PRIVATE KEY-----\nab\n-----END PRIVATE KEY----- tail", "PRIVATE_KEY_REDACTED_01 tail"),
        ("HTTP/1.1 200 OK", "HTTP/1.1 200 OK"),
        ("GNU/Linux", "GNU/Linux"),
        ("std::vector<int> items", "std::vector<int> items"),
        ("nxc -u <username> -p <password>", "nxc -u <username> -p <password>"),
        ("nmap -p 389,445,1433 host", "nmap -p 389,445,1433 host"),
        ("token=null, password=none", "token=null, password=none"),
        ("127.0.0.1 192.0.2.9 169.254.1.1", "127.0.0.1 192.0.2.9 169.254.1.1"),
        ("NT AUTHORITY\\SYSTEM CORP\\jdoe", "NT AUTHORITY\\SYSTEM DOMAIN_USER_01"),
        ("4111 1111 1111 1112", "4111 1111 1111 1112"),
        ("Starting Nmap 7.9 ( https://nmap.org ) at", "Starting Nmap 7.9 ( https://nmap.org ) at"),
        ("", ""),
    ],
)
def test_texts(text, want):
    assert redacted(text) == want


def test_order_and_templates():
    rules = R.built_in()
    assert len(rules) == 50 and len({r.name for r in rules}) == 50 and [r.priority for r in rules] == sorted(r.priority for r in rules)
    assert [r.name for r in rules if not r.enabled] == ["ntlm_hash_bare"]
    for r in rules:
        token = r.template.replace("{mask}", "24").format(n=7)
        assert re.fullmatch(g.TYPED_TOKEN, token), token
        assert re.fullmatch(g.TYPED_TOKEN, r.template.replace("{mask}", "24").format(n=12345))


def test_gates_are_necessary():
    """A gate may only skip texts without a match: each line's rule must find its gate."""
    from cloakwork.plans.lines import LINES

    assert set(LINES) == {r.name for r in R.built_in()}
    assert all(re.compile(p) for p in g.PATTERNS.values())


def test_java_dialect():
    assert to_java(r"(?P<key_a>x)(?P=key_a)\Z") == r"(?U)(?d)(?<keya>x)\k<keya>\z"
    assert group_number(g.PATTERNS["context_secret"], "value") == 2


def test_alias_shares_the_host_number():
    text = "rDNS record for 10.0.0.5: KINGSLANDING\nkingslanding.sevenkingdoms.local castle.north.local"
    assert redacted("castle.north.local kingslanding.sevenkingdoms.local\n" + text.split("\n")[0]) == "[HOST_REDACTED_0001] [HOST_REDACTED_0002]\nrDNS record for [IPV4_REDACTED_0001]: [HOST_SHORT_REDACTED_0002]"


def test_domain_chain_shares_the_domain():
    out = redacted("north.sevenkingdoms.local DC=north,DC=sevenkingdoms,DC=local")
    assert out == "[HOST_REDACTED_0001] DC=[HOST_REDACTED_0001]"


def test_dynamic_rules():
    p = Policy().plus(*R.custom_values(["Night"]), *R.custom_values(["prod"], False), R.custom_pattern("t", r"T-\d+", "[CUSTOM_T_REDACTED_{n:04d}]"), *R.target_domains(["contoso.com"]), *R.targets("username", ["jsmith"]))
    assert redacted("Nightly night PROD prod T-1 T-22 a.contoso.com JSmith.", p) == "[CUSTOM_REDACTED_0001]ly night [CUSTOM_REDACTED_0002] [CUSTOM_REDACTED_0002] [CUSTOM_T_REDACTED_0003] [CUSTOM_T_REDACTED_0004] [HOST_REDACTED_0001] DOMAIN_USER_01."
    for bad in (lambda: R.custom_pattern("n", "x*"), lambda: R.custom_pattern("n", "x", "same"), lambda: R.custom_values([" "]), lambda: R.targets("planet", ["x"]), lambda: R.switched(R.built_in(), ["nope"])):
        with pytest.raises(ValueError):
            bad()


def test_allowed_values_pass():
    assert redacted("10.9.8.7 10.9.8.8", Policy(allow=("10.9.8.7",))) == "10.9.8.7 [IPV4_REDACTED_0001]"


def test_unfolding_is_scoped():
    assert unfold("dn: CN=a,\n DC=b\nx\n y") == "dn: CN=a,DC=b\nx\n y"


def test_restore_needs_whole_tokens():
    o = {"[IPV4_REDACTED_0001]": "10.0.0.1", "DOMAIN_USER_01": "bob"}
    text = "[IPV4_REDACTED_0001] [IPV4_REDACTED_0001]0 [IPV4_REDACTED_0001].evil.test DOMAIN_USER_01. DOMAIN_USER_012"
    assert restore_text(text, o)[0] == "10.0.0.1 [IPV4_REDACTED_0001]0 [IPV4_REDACTED_0001].evil.test bob. DOMAIN_USER_012"
    assert restore_text("x DOMAIN_USER_01 DOMAIN_USER_01", o)[1] == [("restore", "bob", "DOMAIN_USER_01")]
    assert unresolved("[IPV4_REDACTED_0009] DOMAIN_USER_7 [IPV4_REDACTED_0009]") == ["[IPV4_REDACTED_0009]", "DOMAIN_USER_7"]


def test_numbers_grow_past_their_width():
    text = "\n".join(f"h{i}.corp.local" for i in range(1, 121))
    out, originals = sanitize(text)
    assert "[HOST_REDACTED_0120]" in out and len(set(out.split())) == 120 and desanitize(out, originals) == text


def test_ledger_maps():
    p = Policy()
    a = p.ledger()
    redact_text("Dc1.corp.local dc1.CORP.local 10.1.2.3", p, a)
    assert a.original_of["[HOST_REDACTED_0001]"] == "Dc1.corp.local"
    b = Ledger()
    b.load(a.export())
    assert redact_text("10.1.2.3 10.1.2.4", p, b)[0] == "[IPV4_REDACTED_0001] [IPV4_REDACTED_0002]"
    low = a.export()
    low["counters"] = {}
    c = Ledger()
    c.load(low)
    assert redact_text("10.1.2.9", p, c)[0] == "[IPV4_REDACTED_0002]"
    for bad in ([], {"version": True, "mapping": {}, "reverse_mapping": {}}, {"version": 3}, {"version": 2, "mapping": {"a": 1}, "reverse_mapping": {}}, {"version": 2, "mapping": {"a": "T"}, "reverse_mapping": {"U": "a"}}, {"version": 2, "mapping": {}, "reverse_mapping": {}, "counters": {"x": -1}}, "nope"):
        with pytest.raises(ValueError):
            Ledger().load(bad)


def test_known_names_are_replaced_elsewhere():
    out = redacted("sAMAccountName: svc-web\nSVC-WEB ran; xsvc-web not\nCORP\\other")
    assert out.split("\n")[1] == "DOMAIN_USER_02 ran; xsvc-web not"


def test_linear_time():
    import time

    began = time.time()
    redacted("a" * 80_000)
    assert time.time() - began < 2


_PARTS = st.sampled_from(["10.0.0.%d", "user%d@x.org", "dc%d.corp.local", "password=p%dx ", "CORP\\u%d", "https://h%d.io/p", "call 555-123-%04d", "aa:bb:cc:dd:ee:%02d", "plain %d", "\n", " ", "[IPV4_REDACTED_%04d]", "DC=a%d,DC=b"])


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(_PARTS, st.integers(1, 60)), max_size=14))
def test_round_trip(parts):
    text = " ".join(p % n if "%" in p else p for p, n in parts)
    out, originals = sanitize(text)
    assert desanitize(out, originals) == text
    again, _ = sanitize(out)
    assert again == out
