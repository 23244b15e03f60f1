"""Label domains and small fixed lookup tables, kept as data.

FIXED VALUES — these must equal the values the original scripts use, so the
results agree. They are stated plainly and in their natural order.
"""

from __future__ import annotations

# FIXED VALUES: raw label spelling -> standardized name (31 entries).
ATTACK_MAPPING = [
    ("BENIGN", "Benign"),
    ("Benign", "Benign"),
    ("Bot", "Bot"),
    ("DDoS", "DDoS"),
    ("DDoS attacks-LOIC-HTTP", "DDoS"),
    ("DDOS attack-LOIC-UDP", "DDoS"),
    ("DDOS attack-HOIC", "DDoS"),
    ("DoS Hulk", "DoS Hulk"),
    ("DoS attacks-Hulk", "DoS Hulk"),
    ("DoS GoldenEye", "DoS GoldenEye"),
    ("DoS attacks-GoldenEye", "DoS GoldenEye"),
    ("DoS slowloris", "DoS Slowloris"),
    ("DoS Slowloris", "DoS Slowloris"),
    ("DoS attacks-Slowloris", "DoS Slowloris"),
    ("DoS slowhttptest", "DoS Slowhttptest"),
    ("DoS Slowhttptest", "DoS Slowhttptest"),
    ("DoS attacks-SlowHTTPTest", "DoS Slowhttptest"),
    ("FTP-Patator", "FTP-Patator"),
    ("FTP-BruteForce", "FTP-Patator"),
    ("SSH-Patator", "SSH-Patator"),
    ("SSH-Bruteforce", "SSH-Patator"),
    ("Web Attack Brute Force", "Web Attack Brute Force"),
    ("Brute Force -Web", "Web Attack Brute Force"),
    ("Web Attack XSS", "Web Attack XSS"),
    ("Brute Force -XSS", "Web Attack XSS"),
    ("Web Attack Sql Injection", "Web Attack Sql Injection"),
    ("SQL Injection", "Web Attack Sql Injection"),
    ("Infiltration", "Infiltration"),
    ("Infilteration", "Infiltration"),
    ("PortScan", "PortScan"),
    ("Heartbleed", "Heartbleed"),
]

# The 15 standardized names, in first-seen order of the mapping above.
KNOWN_LABELS = list(dict.fromkeys(v for _, v in ATTACK_MAPPING))

# FIXED VALUES: saved label encoder classes (alphabetical; id = position).
ENCODER_CLASSES = [
    "Benign",
    "Bot",
    "DDoS",
    "DoS GoldenEye",
    "DoS Hulk",
    "DoS Slowhttptest",
    "DoS Slowloris",
    "FTP-Patator",
    "Infiltration",
    "SSH-Patator",
    "Web Attack Brute Force",
    "Web Attack Sql Injection",
    "Web Attack XSS",
]

# FIXED VALUES: id -> name map used by the live scoring scripts.
RUNTIME_CLASSES = [
    (0, "Benign"),
    (1, "DDoS"),
    (2, "DoS Hulk"),
    (3, "Bot"),
    (4, "FTP-Patator"),
    (5, "SSH-Patator"),
    (6, "Infiltration"),
    (7, "DoS Slowhttptest"),
    (8, "DoS GoldenEye"),
    (9, "DoS Slowloris"),
    (10, "Web Attack Brute Force"),
    (11, "Web Attack XSS"),
    (12, "Web Attack Sql Injection"),
]

# FIXED VALUES: id -> name map of the text-model evaluation (unknown = 15).
TEXT_EVAL_CLASSES = [
    (0, "Benign"),
    (1, "DoS Hulk"),
    (2, "DoS GoldenEye"),
    (3, "DoS Slowloris"),
    (4, "DoS Slowhttptest"),
    (5, "DDoS"),
    (6, "Bot"),
    (7, "FTP-Patator"),
    (8, "SSH-Patator"),
    (9, "Web Attack Brute Force"),
    (10, "Web Attack XSS"),
    (11, "Web Attack Sql Injection"),
    (12, "Infiltration"),
    (13, "Heartbleed"),
    (14, "PortScan"),
]
TEXT_EVAL_UNKNOWN = 15

# FIXED VALUES: alert-model label mapping (name -> id), Unknown = 13.
ALERT_MODEL_CLASSES = [
    ("DDoS", 0),
    ("DoS Hulk", 1),
    ("Bot", 2),
    ("FTP-Patator", 3),
    ("SSH-Patator", 4),
    ("Infiltration", 5),
    ("DoS Slowhttptest", 6),
    ("DoS GoldenEye", 7),
    ("DoS Slowloris", 8),
    ("Web Attack Brute Force", 9),
    ("Web Attack XSS", 10),
    ("Web Attack Sql Injection", 11),
    ("Benign", 12),
    ("Unknown", 13),
]
ALERT_MODEL_UNKNOWN = 13

# FIXED VALUES: well-known port -> service name.
COMMON_PORTS = [
    (20, "FTP-Data"),
    (21, "FTP-Control"),
    (22, "SSH"),
    (23, "Telnet"),
    (25, "SMTP"),
    (80, "HTTP"),
    (443, "HTTPS"),
    (3389, "RDP"),
    (8080, "HTTP-Alt"),
]

# FIXED VALUES: IP protocol number -> name.
PROTOCOLS = [(1, "ICMP"), (6, "TCP"), (17, "UDP")]

# FIXED VALUES: TCP flag masks, in bit order, with the feature names they fill.
TCP_FLAG_MASKS = [
    ("fin_flag_cnt", 0x01),
    ("syn_flag_cnt", 0x02),
    ("rst_flag_cnt", 0x04),
    ("psh_flag_cnt", 0x08),
    ("ack_flag_cnt", 0x10),
    ("urg_flag_cnt", 0x20),
    ("cwe_flag_count", 0x40),
    ("ece_flag_cnt", 0x80),
]

# FIXED VALUES: columns a flow file must carry, and identity columns dropped before training.
REQUIRED_COLUMNS = [
    "Dst Port", "Protocol", "Timestamp", "Flow Duration",
    "Tot Fwd Pkts", "Tot Bwd Pkts", "TotLen Fwd Pkts", "TotLen Bwd Pkts",
    "Label",
]
IDENTITY_COLUMNS = ["Timestamp", "Flow ID", "Src IP", "Dst IP"]

# FIXED VALUES: keywords of the notification line filter.
NOTIFICATION_KEYWORDS = ["attack", "mitigation", "implications", "security"]

# Mapping names offered by ``label_dim``.
LABEL_MAPS = {
    "encoder": [(i, n) for i, n in enumerate(ENCODER_CLASSES)],
    "runtime": RUNTIME_CLASSES,
    "text_eval": TEXT_EVAL_CLASSES,
    "alert_model": [(i, n) for n, i in ALERT_MODEL_CLASSES],
}
