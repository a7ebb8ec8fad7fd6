"""Lines that fire one rule each, as SQL expressions over a row's key.

The expressions are valid in Spark SQL and DuckDB. No complete token stands in this file: pieces
are joined, and fillers are made of the row's key, when the query runs.
"""

from __future__ import annotations

import re

# Fillers: name(n) is the key padded on the left to n characters.
_PADS = {"A": "a1B", "U": "QX7", "H": "a9f", "L": "qz", "D": "7"}

# One line per rule in catalogue order. Outside quotes, X(n) is a filler, Q a single
# quote, DQ a double quote and ID a hexadecimal UUID.
LINES = (
    "'sk-' A(20) 'T3Blbk' 'FJ' A(20)",
    "'sk-' 'proj-' A(48)",
    "'sk-' 'ant-api03-' A(93)",
    "'h' 'f_' A(34)",
    "'cohere_api_key=' A(40)",
    "'r8' '_' A(38)",
    "'gemini_api_key: AI' 'za' A(35)",
    "'pinecone_api_key=' ID",
    "DQ 'AK' 'IA' U(16) DQ",
    "'aws_secret_access_key=' A(40)",
    "'amzn.' 'mws.' ID",
    "'aws_session_token=' A(100)",
    "'aws_account_id=' D(12)",
    "'account_key=' A(88)",
    "'azure_client_secret=' A(34)",
    "'DefaultEndpoints' 'Protocol=https;AccountName=acct;AccountKey=' A(88)",
    "'dop' '_v1_' H(64)",
    "'doo' '_v1_' H(64)",
    "'dor' '_v1_' H(64)",
    "'spaces_access_key=' U(20)",
    "'heroku_api_key=' ID",
    "'LT' 'AI' A(20)",
    "'mongodb+srv://u:' A(9) '@h/db'",
    "'postgres://u:' A(9) '@h/db'",
    "'mysql://u:' A(9) '@h/db'",
    "'rediss://:' A(9) '@h:1'",
    "'jdbc:mysql://h/db?password=' A(9)",
    "'db_password=' Q A(9) Q",
    "'AI' 'za' A(35)",
    "DQ 'type' DQ ': ' DQ 'service_account' DQ",
    "'client_secret=' A(24)",
    "D(12) '-' L(32) '.apps.googleusercontent.com'",
    "'https://app-' L(9) '.firebaseio.com'",
    "'pwd=' Q A(9) Q",
    "'secret: ' Q A(9) Q",
    "'token = ' Q A(9) Q",
    "'apikey=' Q A(9) Q",
    "'-----BEGIN ' 'RSA PRIVATE KEY' '-----'",
    "'-----BEGIN ' 'OPENSSH PRIVATE KEY' '-----'",
    "'-----BEGIN ' 'EC PRIVATE KEY' '-----'",
    "'-----BEGIN ' 'DSA PRIVATE KEY' '-----'",
    "'-----BEGIN ' 'PRIVATE KEY' '-----'",
    "'-----BEGIN ' 'PGP PRIVATE KEY BLOCK' '-----'",
    "'Authorization: Bearer ' A(20)",
    "'Authorization: Basic ' A(10)",
    "'https://u:' A(9) '@h/p'",
    "'export MY_TOKEN=' A(9)",
    "'gh' 'p_' A(36)",
    "'github' '_pat_' A(22) '_' A(59)",
    "'gh' 'o_' A(36)",
    "'gh' 'u_' A(36)",
    "'gh' 's_' A(36)",
    "'gh' 'r_' A(36)",
    "'-----BEGIN ' 'RSA PRIVATE KEY' '-----'",
    "'xox' 'b-' D(10) '-' D(11) '-' A(24)",
    "'xox' 'p-' D(10) '-' D(11) '-' D(12) '-' H(32)",
    "'xa' 'pp-1-A1-' D(9) '-' L(9)",
    "'https://hooks.' 'slack.com/services/T1/B1/' A(9)",
    "'M' A(23) '.' A(6) '.' A(27)",
    "'https://discord' 'app.com/api/webhooks/' D(9) '/' A(9)",
    "'A' 'C' H(32)",
    "'twilio_auth_token=' H(32)",
    "'S' 'K' H(32)",
    "'S' 'G.' A(22) '.' A(43)",
    "'key-' A(32)",
    "D(9) ':' A(35)",
    "'sk' '_live_' A(24)",
    "'sk' '_test_' A(24)",
    "'pk' '_live_' A(24)",
    "'rk' '_live_' A(24)",
    "'wh' 'sec_' A(32)",
    "'access_token$' 'production$' L(16) '$' H(32)",
    "'sq0' 'atp-' A(22)",
    "'sq0' 'csp-' A(43)",
    "'shp' 'at_' H(32)",
    "'shp' 'ca_' H(32)",
    "'shp' 'pa_' H(32)",
    "'shp' 'ss_' H(32)",
)

_PIECE = re.compile(r"'[^']*'|DQ|Q|ID|([AUHLD])\((\d+)\)")


def line_sql(line: str, key: str) -> str:
    """The SQL expression of one planted line for rows with the string expression ``key``."""
    def pad(n: int, kind: str) -> str:
        return f"lpad({key}, {n}, '{_PADS[kind]}')"

    def piece(token: re.Match) -> str:
        text = token.group()
        if text == "ID":
            return f"concat({pad(8, 'H')}, '-0a1b-2c3d-4e5f-', {pad(12, 'H')})"
        if text in ("Q", "DQ"):
            return "chr(39)" if text == "Q" else "chr(34)"
        return text if text[0] == "'" else pad(int(token[2]), token[1])

    pieces = ", ".join(piece(token) for token in _PIECE.finditer(line))
    return f"concat('  pre ', {pieces}, ' post')"


def block_sql(key: str) -> str:
    """All planted lines, joined by newlines."""
    return "concat_ws(chr(10), " + ", ".join(line_sql(line, key) for line in LINES) + ")"
