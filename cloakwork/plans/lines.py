"""One line per supplier for each rule: how it is made, and what must become of it. Both are SQL that Spark and DuckDB read alike.

`k` is the supplier's key. The expected text is made from the keys alone, not by any pattern, so it checks the rules independently.
"""

from __future__ import annotations

_A, _B, _C = "md5('a' || k)", "md5('b' || k)", "md5('c' || k)"
_SL = "chr(92)"  # a backslash, which the two dialects quote differently

LINES: dict[str, tuple[str, str]] = {
    "private_key": (f"'key -----BEGIN RSA PRIVATE KEY-----' || {_A} || '-----END RSA PRIVATE KEY----- end'", "'key PRIVATE_KEY_REDACTED_01 end'"),
    "kerberos_hash": (f"'got $krb5tgs$23$*svc' || k || '$CORP.LOCAL$x*$' || {_A} || '$' || {_B}", "'got KERBEROS_HASH_01'"),
    "sam_dump": (f"'svc' || k || ':' || (1000 + k) || ':' || {_A} || ':' || {_B} || ':::'", "'SAM_DUMP_01'"),
    "ntlmv2_hash": (f"'hash user' || k || '::CORP:' || substr({_C}, 1, 16) || ':' || {_A} || ':' || {_B} || ' done'", "'hash NTLMV2_HASH_01 done'"),
    "kerberos_key": (f"'x dc' || k || '$:aes256-cts-hmac-sha1-96:' || {_A} || ' y'", "'x KERBEROS_KEY_01 y'"),
    "jwt": (f"'jwt eyJ' || {_A} || '.eyJ' || {_B} || '.' || {_C} || ' end'", "'jwt JWT_REDACTED_01 end'"),
    "aws_key": (f"'id AKIA' || upper(substr({_A}, 1, 16)) || ' end'", "'id API_KEY_01 end'"),
    "dcc2_hash": (f"'$DCC2$10240#user' || k || '#' || {_A} || ' end'", "'DCC2_HASH_01 end'"),
    "dpapi_key": (f"'dpapi_machinekey:0x' || {_A} || ' end'", "'DPAPI_KEY_01 end'"),
    "machine_hex_password": (f"'plain_password_hex:' || {_A} || ' end'", "'MACHINE_HEX_PW_01 end'"),
    "ntlm_hash": (f"'pair ' || {_A} || ':' || {_B} || ' end'", "'pair NTLM_HASH_01 end'"),
    "impacket_hashes": (f"'tool -hashes :' || {_A} || ' end'", "'tool -hashes :NTLM_HASH_01 end'"),
    "nthash_plaintext": (f"{_A} || ':Summer' || k", "'NTLM_HASH_01:[SECRET_REDACTED_0001]'"),
    "ntlm_hash_bare": (f"'bare ' || {_A} || ' end'", "'bare NTLM_HASH_01 end'"),
    "domain_context": ("'Domain: corp' || k || '.example.org end'", "'Domain: [DOMAIN_REDACTED_0001] end'"),
    "context_secret": (f"'api_key=zz' || {_A} || ' end'", "'api_key=[SECRET_REDACTED_0001] end'"),
    "prose_secret": ("'The password is \"Hunter' || k || '!\" today'", "'The password is \"[SECRET_REDACTED_0001]\" today'"),
    "smb_user_pass": ("'smbclient -U admin' || k || '%Pass' || k || ' //srv/share'", "'smbclient -U DOMAIN_USER_01%[SECRET_REDACTED_0001] //srv/share'"),
    "cli_flag_secret": ("'nxc smb -u svc' || k || ' -p Secret' || k || ' end'", "'nxc smb -u DOMAIN_USER_01 -p [SECRET_REDACTED_0001] end'"),
    "slash_param_secret": (f"'Rubeus /rc4:' || {_A} || ' end'", "'Rubeus /rc4:[SECRET_REDACTED_0001] end'"),
    "windows_sid": ("'sid S-1-5-21-1-2-' || (100 + k) || '-500 end'", "'sid SID_REDACTED_01 end'"),
    "ssn": ("'ssn 123-45-' || (1000 + k % 9000) || ' end'", "'ssn SSN_REDACTED_01 end'"),
    "credit_card": ("'card 4111 1111 1111 1111 of ' || k", "'card CC_REDACTED_01 of ' || k"),
    "spn": ("'spn HTTP/web' || k || '.corp.example end'", "'spn SPN_01 end'"),
    "ad_domain_user": (f"'login CORP' || {_SL} || 'user' || k || ' end'", "'login DOMAIN_USER_01 end'"),
    "ad_domain_user_slash": ("'psexec CORP/user' || k || ':Passw0rd@10.1.2.3 end'", "'psexec DOMAIN_USER_01 end'"),
    "url": ("'see https://host' || k || '.example.com/a?b=1 end'", "'see URL_REDACTED_01 end'"),
    "email": ("'mail bob' || k || '@corp' || k || '.com end'", "'mail [EMAIL_REDACTED_0001] end'"),
    "phone": ("'call 555-123-' || (1000 + k % 9000) || ' end'", "'call [PHONE_REDACTED_0001] end'"),
    "unc_path": (f"'open ' || {_SL} || {_SL} || 'srv' || k || {_SL} || 'share end'", "'open UNC_PATH_01 end'"),
    "linux_home_path": ("'in /home/user' || k || '/x'", "'in /home/[SECRET_REDACTED_0001]/x'"),
    "windows_user_path": (f"'in C:' || {_SL} || 'Users' || {_SL} || 'user' || k || {_SL} || 'x'", f"'in C:' || {_SL} || 'Users' || {_SL} || '[SECRET_REDACTED_0001]' || {_SL} || 'x'"),
    "cidr": ("'net 10.' || (k % 250) || '.0.0/16 end'", "'net [CIDR_REDACTED_0001]/16 end'"),
    "ipv4": ("'ip 10.9.' || (k % 250) || '.7 end'", "'ip [IPV4_REDACTED_0001] end'"),
    "ipv6": ("'v6 2001:db8::' || (k % 9999) || ' end'", "'v6 [IPV6_REDACTED_0001] end'"),
    "mac": (f"'mac aa:bb:cc:dd:ee:' || substr({_A}, 1, 2) || ' end'", "'mac [MAC_REDACTED_0001] end'"),
    "hostname_internal": ("'host dc' || k || '.corp.local up'", "'host [HOST_REDACTED_0001] up'"),
    "rdns_single_label": ("'rDNS record for 10.0.0.1: SRV' || k || ' '", "'rDNS record for [IPV4_REDACTED_0001]: [HOST_SHORT_REDACTED_0001] '"),
    "smb_netbios_name": ("'x (name:SRV' || k || ') y'", "'x (name:[HOST_SHORT_REDACTED_0001]) y'"),
    "ldap_dn_domain": ("'base DC=corp' || k || ',DC=example end'", "'base DC=[DOMAIN_REDACTED_0001] end'"),
    "ldap_samaccountname": ("'sAMAccountName: jdoe' || k || ' '", "'sAMAccountName: DOMAIN_USER_01 '"),
    "impacket_status_user": ("'[-] User jdoe' || k || ' has no preauth'", "'[-] User DOMAIN_USER_01 has no preauth'"),
    "netexec_spray_password": ("'[*] Trying: Spring' || k || ' on corp'", "'[*] Trying: [SECRET_REDACTED_0001] on corp'"),
    "ldap_cn_lowercase_user": ("'CN=jon' || k || ',OU=x'", "'CN=DOMAIN_USER_01,OU=x'"),
    "ldap_comment_user": ("'# jon' || k || ', Users, x'", "'# DOMAIN_USER_01, Users, x'"),
    "nmap_ntlm_field": ("'|   Target_Name: CORP' || k", "'|   Target_Name: [HOST_SHORT_REDACTED_0001]'"),
    "kerberoast_table_name": ("'HTTP/web.corp.example  svc' || k || '  x'", "'SPN_01  DOMAIN_USER_01  x'"),
    "ldap_description": ("'description: Some person ' || k", "'description: DOMAIN_USER_01'"),
    "json_description": ("'\"description\": \"Jon ' || k || '\"'", "'\"description\": \"DOMAIN_USER_01\"'"),
    "ldap_cn_users_member": ("'x CN=Night Watch ' || k || ',CN=Users,DC=x'", "'x CN=DOMAIN_USER_01,CN=Users,DC=x'"),
}

#: What else must hold of a document: name -> (line, expected)
CASES: dict[str, tuple[str, str]] = {
    "mac_canonical": (f"'aa:bb:cc:dd:ee:' || substr({_A}, 1, 2) || ' AA-BB-CC-DD-EE-' || upper(substr({_A}, 1, 2)) || ' aabb.ccdd.ee' || substr({_A}, 1, 2)", "'[MAC_REDACTED_0001] [MAC_REDACTED_0001] [MAC_REDACTED_0001]'"),
    "ipv6_canonical": ("'2001:DB8::' || (k % 9999) || ' 2001:0db8:0:0:0:0:0:' || (k % 9999)", "'[IPV6_REDACTED_0001] [IPV6_REDACTED_0001]'"),
    "hostname_casefold": ("'dc' || k || '.corp.local DC' || k || '.CORP.local'", "'[HOST_REDACTED_0001] [HOST_REDACTED_0001]'"),
    "cross_category_reuse": ("'password=10.9.' || (k % 250) || '.5 then 10.9.' || (k % 250) || '.5'", "'password=[SECRET_REDACTED_0001] then [SECRET_REDACTED_0001]'"),
    "ad_slash_dn_shared_domain": ("'corp' || k || '.local and DC=corp' || k || ',DC=local'", "'[HOST_REDACTED_0001] and DC=[HOST_REDACTED_0001]'"),
    "cidr_cross_mask": ("'10.' || (k % 250) || '.0.0/16 and 10.' || (k % 250) || '.0.0/24 and 10.' || (k % 250) || '.0.0/16'", "'[CIDR_REDACTED_0001]/16 and [CIDR_REDACTED_0002]/24 and [CIDR_REDACTED_0001]/16'"),
    "reserved_tokens_skip": ("'[CIDR_REDACTED_0001]/24 and 10.' || (k % 250) || '.0.0/16'", "'[CIDR_REDACTED_0001]/24 and [CIDR_REDACTED_0002]/16'"),
    "reserved_hosts_skip": ("'HOST_01.example.internal and dc' || k || '.corp.local'", "'HOST_01.example.internal and [HOST_REDACTED_0002]'"),
    "retrospective_replace": ("'sAMAccountName: svc-web' || k || chr(10) || 'later SVC-WEB' || k || ' ran'", "'sAMAccountName: DOMAIN_USER_01' || chr(10) || 'later DOMAIN_USER_01 ran'"),
    "host_renumber": ("'(name:SRVB' || k || ') then alpha' || k || '.corp.local'", "'(name:[HOST_SHORT_REDACTED_0001]) then [HOST_REDACTED_0002]'"),
    "ldap_unfold": ("'dn: CN=x,OU=abc' || k || chr(10) || ' def' || k || chr(10) || 'plain' || chr(10) || ' indented'", "'dn: CN=x,OU=abc' || k || 'def' || k || chr(10) || 'plain' || chr(10) || ' indented'"),
    "pass_through": ("'HTTP/1.1 200 OK GNU/Linux std::vector<int> items 127.0.0.1 nmap -p 389,' || (k % 60000)", "'HTTP/1.1 200 OK GNU/Linux std::vector<int> items 127.0.0.1 nmap -p 389,' || (k % 60000)"),
}

#: Rules that come with a run: name -> (kind, arguments in the policy, line, expected)
DYNAMIC: dict[str, tuple[str, list[str], str, str]] = {
    "custom_value_cs": ("custom", ["Nighthawk"], "'project Nighthawk' || k || ' and nighthawk'", "'project [CUSTOM_REDACTED_0001]' || k || ' and nighthawk'"),
    "custom_value_ci": ("custom_nocase", ["proddb"], "'db ProdDB and PRODDB of ' || k", "'db [CUSTOM_REDACTED_0001] and [CUSTOM_REDACTED_0001] of ' || k"),
    "custom_pattern": ("pattern", ["TKT-[0-9]+"], "'see TKT-' || k || ' now'", "'see [CUSTOM_REDACTED_0001] now'"),
    "target_domain": ("domain", ["contoso.com"], "'web' || k || '.contoso.com and contoso.com'", "'[HOST_REDACTED_0001] and [HOST_REDACTED_0002]'"),
    "target_hostname_alias": ("hostname", ["DC01"], "'dc01.corp' || k || '.local is DC01.'", "'[HOST_REDACTED_0001] is [HOST_SHORT_REDACTED_0001].'"),
    "target_username": ("username", ["jsmith"], "'by jsmith in ' || k", "'by DOMAIN_USER_01 in ' || k"),
    "target_netbios": ("netbios", ["ACME"], "'at ACME in ' || k", "'at [DOMAIN_REDACTED_0001] in ' || k"),
    "target_share": ("share", ["HR-Data"], "'on HR-Data in ' || k", "'on [SHARE_REDACTED_0001] in ' || k"),
    "allowlist": ("allow", ["10.9.8.7"], "'10.9.8.7 and 10.9.9.' || (k % 250)", "'10.9.8.7 and [IPV4_REDACTED_0001]'"),
}
