"""Alert and example text templates, kept as data.

FIXED VALUES — the wording below must equal the original alert texts so the
generated strings agree. Placeholders are written ``{name}``; ``netsieve.functions.alerts``
cuts each text once into its literal and value pieces.
"""

from __future__ import annotations

# FIXED VALUES: detail block of the intended alert, per attack type (default: Unknown).
DETAIL = {
    "DoS Slowhttptest": """Attack Details:
        - Connection Hold Time: {iat_mean} ms
        - Request Rate: {packet_rate} requests/sec
        - Traffic Pattern: {volume_pattern}
        - Protocol: {protocol_name}
        - {port_analysis}
        - Attack Vector: {dos_vector}
        - Impact Level: {impact_level}
        - Attack Signature: Slow HTTP headers""",
    "DDoS": """Attack Details:
        - Flow Rate: {flow_rate} bytes/sec
        - Packet Rate: {packet_rate} packets/sec
        - Protocol: {protocol_name}
        - {port_analysis}
        - Connection Pattern: {traffic_pattern}
        - SYN Flags: {syn_flags}
        - RST Flags: {rst_flags}
        - Impact Level: {impact_level}
        - Attack Vector: {syn_vector}""",
    "FTP-Patator": """Attack Details:
        - Attack Rate: {packet_rate} attempts/sec
        - Protocol: {protocol_name}
        - {port_analysis}
        - Failed Connections: {rst_flags}
        - Connection Pattern: {rate_pattern}
        - Impact Level: {impact_level}
        - Forward Packets: {tot_fwd_pkts}
        - Backward Packets: {tot_bwd_pkts}
        - Attack Vector: FTP Brute Force""",
    "SSH-Patator": """Attack Details:
        - Attack Rate: {packet_rate} attempts/sec
        - Protocol: {protocol_name}
        - {port_analysis}
        - Failed Connections: {rst_flags}
        - Connection Pattern: {rate_pattern}
        - Impact Level: {impact_level}
        - Forward Packets: {tot_fwd_pkts}
        - Backward Packets: {tot_bwd_pkts}
        - Attack Vector: SSH Brute Force""",
    "Web Attack Brute Force": """Attack Details:
        - Attack Rate: {packet_rate} attempts/sec
        - Protocol: {protocol_name}
        - {port_analysis}
        - Header Length: {fwd_header_len} bytes
        - Response Size: {bwd_pkt_len_mean} bytes
        - Connection Pattern: {rate_pattern}
        - Impact Level: {impact_level}
        - Attack Vector: Web Authentication Brute Force""",
    "Web Attack XSS": """Attack Details:
        - Request Rate: {packet_rate} requests/sec
        - Protocol: {protocol_name}
        - {port_analysis}
        - Payload Size: {fwd_pkt_len_mean} bytes
        - Response Size: {bwd_pkt_len_mean} bytes
        - Impact Level: {impact_level}
        - Pattern: {payload_pattern}
        - Attack Vector: Cross-Site Scripting""",
    "Web Attack Sql Injection": """Attack Details:
        - Request Rate: {packet_rate} requests/sec
        - Protocol: {protocol_name}
        - {port_analysis}
        - Query Size: {fwd_pkt_len_mean} bytes
        - Response Size: {bwd_pkt_len_mean} bytes
        - Impact Level: {impact_level}
        - Pattern: {query_pattern}
        - Attack Vector: SQL Injection""",
    "DoS Hulk": """Attack Details:
        - Flow Rate: {flow_rate} bytes/sec
        - Protocol: {protocol_name}
        - {port_analysis}
        - Request Rate: {packet_rate} requests/sec
        - Connection Pattern: {traffic_pattern}
        - Impact Level: {impact_level}
        - Attack Vector: HTTP Flood""",
    "DoS GoldenEye": """Attack Details:
        - Flow Rate: {flow_rate} bytes/sec
        - Protocol: {protocol_name}
        - {port_analysis}
        - Request Rate: {packet_rate} requests/sec
        - Connection Pattern: {traffic_pattern}
        - Keep-alive Connections: {syn_flags}
        - Impact Level: {impact_level}
        - Attack Vector: Resource Exhaustion""",
    "DoS Slowloris": """Attack Details:
        - Connection Hold Time: {iat_mean} ms
        - Protocol: {protocol_name}
        - {port_analysis}
        - Active Connections: {active_connections}
        - Request Rate: {packet_rate} requests/sec
        - Impact Level: {impact_level}
        - Attack Vector: Connection Pool Exhaustion""",
}
DETAIL_DEFAULT = """Attack Details:
        - Flow Rate: {flow_rate} bytes/sec
        - Packet Rate: {packet_rate} packets/sec
        - Protocol: {protocol_name}
        - {port_analysis}
        - Connection Pattern: {traffic_pattern}
        - Forward Packets: {tot_fwd_pkts}
        - Backward Packets: {tot_bwd_pkts}
        - Alert Confidence: {slm_score}"""

# FIXED VALUES: mitigation and impact of the intended alert (default: Unknown).
MITIGATION = {
    "DoS Slowhttptest": """• Configure aggressive timeout policies
• Implement request rate limiting
• Enable mod_reqtimeout
• Monitor server resources""",
}
MITIGATION_DEFAULT = """• Enable enhanced monitoring
• Update security signatures
• Review system logs
• Implement additional filtering"""
IMPACT = {"DoS Slowhttptest": "Web server resources being exhausted through connection pool depletion"}
IMPACT_DEFAULT = "Potential security risk requiring investigation and monitoring"

ALERT_TEXT = "THREAT: {threat}\n\n{details}\n\nMITIGATION:\n{mitigation}\n\nIMPACT: {impact}"

# FIXED VALUES: second detail block (severity alert), per attack type.
DETAIL2 = {
    "DDoS": """Attack Details:
• Flow Rate: {flow_rate} bytes/sec
• Packet Rate: {packet_rate} packets/sec
• Average Flow Interval: {iat_mean} ms
• Traffic Pattern: {traffic_pattern}
• Protocol: {protocol}
• SYN Flags: {syn_flags} (potential SYN flood indicators)
• RST Flags: {rst_flags} (connection reset attempts)""",
    "DoS Hulk": """Attack Details:
• HTTP Request Rate: {packet_rate} requests/sec
• Traffic Volume: {flow_rate} bytes/sec
• Connection Pattern: {hulk_pattern} traffic
• Target Port: {dst_port}
• Header Size: {fwd_header_len} bytes (forward), {bwd_header_len} bytes (backward)
• Attack Signature: High-volume HTTP POST floods""",
    "Bot": """Attack Details:
• Bot Behavior Pattern: {traffic_pattern}
• Traffic Volume: {flow_rate} bytes/sec
• Connection Interval: {iat_mean} ms
• Command Channel: Port {src_port}
• Connection Attempts: {syn_flags} SYN flags
• Failed Connections: {rst_flags} RST flags
• Automated Pattern: {bot_pattern}""",
    "FTP-Patator": """Attack Details:
• Authentication Attempts Rate: {packet_rate} tries/sec
• Connection Pattern: {ftp_pattern}
• Target FTP Port: {dst_port}
• Protocol Violations: {rst_flags} RST flags
• Connection Attempts: {syn_flags} SYN flags
• Traffic Volume: {flow_rate} bytes/sec""",
    "SSH-Patator": """Attack Details:
• Login Attempt Rate: {packet_rate} attempts/sec
• Connection Pattern: {ssh_pattern}
• Target SSH Port: {dst_port}
• Failed Connections: {rst_flags} RST flags
• New Connection Attempts: {syn_flags} SYN flags
• Average Attempt Interval: {iat_mean} ms""",
    "Infiltration": """Attack Details:
• Infiltration Pattern: {traffic_pattern}
• Data Flow Rate: {flow_rate} bytes/sec
• Connection Behavior: {iat_mean} ms intervals
• Protocol Used: {protocol}
• Suspicious Headers: {header_sum} total bytes
• Connection Attempts: {syn_flags} initiations
• Anomalous Terminations: {rst_flags} resets""",
    "DoS Slowhttptest": """Attack Details:
• Connection Hold Time: {iat_mean} ms
• Request Rate: {packet_rate} requests/sec
• Traffic Pattern: Low-and-slow attack signature
• Target Port: {dst_port}
• Header Manipulation: {fwd_header_len} bytes
• Active Connections: {active_connections} maintained
• Connection Strategy: Partial HTTP requests""",
    "DoS GoldenEye": """Attack Details:
• Attack Intensity: {flow_rate} bytes/sec
• Request Frequency: {packet_rate} packets/sec
• Connection Pattern: {goldeneye_pattern}
• Target Service: Port {dst_port}
• HTTP Headers: {fwd_header_len} bytes
• Connection Floods: {syn_flags} attempts
• Resource Exhaustion: {exhaustion_level}""",
    "DoS Slowloris": """Attack Details:
• Connection Hold Pattern: {iat_mean} ms intervals
• Active Connections: {active_connections} maintained
• Target Web Port: {dst_port}
• Traffic Pattern: Low bandwidth, high connection count
• Header Size: {fwd_header_len} bytes
• Connection Strategy: Keep-alive abuse
• Resource Impact: Connection pool exhaustion""",
    "Web Attack Brute Force": """Attack Details:
• Authentication Attempt Rate: {packet_rate} tries/sec
• Request Pattern: {traffic_pattern}
• Target Port: {dst_port}
• Request Size: {fwd_header_len} bytes
• Response Size: {bwd_header_len} bytes
• Failed Attempts: {rst_flags} connection resets
• Attack Signature: Repetitive POST requests""",
    "Web Attack XSS": """Attack Details:
• Injection Attempt Rate: {packet_rate} requests/sec
• Payload Size: {flow_rate} bytes/sec
• Target Service: Port {dst_port}
• Request Headers: {fwd_header_len} bytes
• Script Pattern: {xss_pattern}
• Attack Vector: HTTP GET/POST with script injection""",
    "Web Attack Sql Injection": """Attack Details:
• SQL Attempt Pattern: {traffic_pattern}
• Payload Size: {flow_rate} bytes/sec
• Request Rate: {packet_rate} requests/sec
• Target Port: {dst_port}
• Query Length: {fwd_header_len} bytes
• Attack Vector: {sql_pattern} SQL patterns
• Response Size: {bwd_header_len} bytes""",
    "Benign": """Traffic Details:
• Flow Rate: {flow_rate} bytes/sec
• Packet Rate: {packet_rate} packets/sec
• Protocol: {protocol}
• Connection Pattern: Normal
• Port Usage: {src_port} → {dst_port}""",
}
DETAIL2_DEFAULT = """Attack Details:
• Flow Rate: {flow_rate} bytes/sec
• Packet Rate: {packet_rate} packets/sec
• Protocol: {protocol}
• Source Port: {src_port}
• Destination Port: {dst_port}
• Connection Pattern: {traffic_pattern}"""

CONFIDENCE_TEXT = ("{severity} - THREAT: {threat} (Confidence: {confidence})\n\n{details}\n\n"
                   "MITIGATION:\n{mitigation}\n\nIMPACT: {impact}")

# FIXED VALUES: description / mitigations / impact per attack type for training
# examples and the severity alert (default: Unknown).
EXAMPLE = {
    "Benign": ("Normal network traffic pattern observed with {flow_rate} Flow Bytes/s",
               ["Continue standard monitoring", "Maintain security baselines", "Regular system health checks"],
               "No security impact - normal operations"),
    "DDoS": ("Distributed Denial of Service attack detected with {flow_rate} Flow Bytes/s targeting port {dst_port}",
             ["Activate DDoS mitigation services", "Enable traffic scrubbing", "Scale infrastructure capacity"],
             "Service availability compromised, potential system overload"),
    "DoS Hulk": ("DoS Hulk attack detected with {pkt_rate} packets/sec targeting HTTP services",
                 ["Deploy HTTP-specific filtering", "Implement request rate limiting",
                  "Enable application layer protection"],
                 "Web server resources exhausted, service degradation likely"),
    "Bot": ("Bot activity identified with unusual IAT patterns (mean: {iat_mean})",
            ["Deploy bot detection mechanisms", "Implement behavioral analysis", "Block suspicious automation patterns"],
            "System resources being consumed by automated threats"),
    "FTP-Patator": ("FTP brute force attack detected on port {dst_port} with high connection rate",
                    ["Enable FTP access controls", "Implement login attempt limiting", "Monitor FTP authentication logs"],
                    "FTP service at risk of unauthorized access"),
    "SSH-Patator": ("SSH brute force attack detected targeting port {dst_port}",
                    ["Enable SSH key-based authentication", "Implement IP blacklisting", "Set maximum auth attempts"],
                    "SSH service facing unauthorized access attempts"),
    "Infiltration": ("Infiltration attempt detected with suspicious traffic pattern on port {dst_port}",
                     ["Isolate affected systems", "Enable deep packet inspection", "Update intrusion prevention rules"],
                     "Potential system compromise and data breach risk"),
    "DoS Slowhttptest": ("Slowhttptest DoS attack detected targeting web services",
                         ["Adjust connection timeouts", "Implement request limiting",
                          "Configure maximum connection settings"],
                         "Web server resources being slowly exhausted"),
    "DoS GoldenEye": ("GoldenEye DoS attack detected with {flow_rate} Flow Bytes/s",
                      ["Enable application layer filtering", "Implement connection limiting", "Deploy anti-DoS measures"],
                      "HTTP service availability being degraded"),
    "DoS Slowloris": ("Slowloris DoS attack identified targeting HTTP services",
                      ["Configure connection timeouts", "Enable mod_reqtimeout",
                       "Implement concurrent connection limits"],
                      "Web server connections being exhausted"),
    "Web Attack Brute Force": ("Web authentication brute force attack detected on port {dst_port}",
                               ["Enable account lockout policies", "Implement CAPTCHA protection",
                                "Monitor authentication attempts"],
                               "Web application authentication at risk"),
    "Web Attack XSS": ("Cross-site scripting attack detected in web traffic",
                       ["Enable XSS filtering", "Implement input sanitization", "Update WAF rules"],
                       "Web application vulnerable to client-side attacks"),
    "Web Attack Sql Injection": ("SQL injection attempt detected in web traffic",
                                 ["Enable SQL injection protection", "Implement prepared statements",
                                  "Update database access controls"],
                                 "Database security at risk of compromise"),
    "Unknown": ("Unknown malicious activity detected on port {dst_port} with anomalous characteristics "
                "(Flow Rate: {flow_rate}, Packet Rate: {pkt_rate})",
                ["Enable enhanced monitoring and logging", "Isolate suspicious traffic for analysis",
                 "Update security signatures and rules"],
                "Potential new or variant attack requiring immediate investigation"),
}

# FIXED VALUES: fallback alert (the definition that runs), per type; default last.
FALLBACK = {
    "DDoS": ("A DDoS attack has been detected targeting {port_info} with a high confidence score of {score}.",
             "1. Activate DDoS mitigation services and traffic scrubbing\n"
             "2. Implement rate limiting and connection throttling\n"
             "3. Scale infrastructure capacity and enable redundant systems",
             "Service availability is at risk, potentially affecting customer operations and business continuity."),
    "Bot": ("Automated bot activity detected on {port_info} showing suspicious behavioral patterns.",
            "1. Deploy advanced bot detection mechanisms\n"
            "2. Implement IP-based rate limiting and CAPTCHA\n"
            "3. Update WAF rules to filter malicious bot signatures",
            "Bot activity may degrade service performance and consume valuable system resources."),
    "Web Attack": ("Web-based attack detected targeting {port_info} with suspicious payload characteristics.",
                   "1. Enable enhanced WAF filtering\n"
                   "2. Update input validation rules\n"
                   "3. Patch vulnerable components and systems",
                   "Potential data breach risk and system compromise if attack succeeds."),
}
FALLBACK_DEFAULT = (
    "Suspicious {attack_type} activity detected on {port_info} with anomalous traffic patterns.",
    "1. Isolate affected systems and enable enhanced monitoring\n"
    "2. Update security rules and signatures\n"
    "3. Review and restrict network access policies",
    "Security breach could lead to system compromise and data exposure.",
)
FALLBACK_TEXT = "THREAT: {threat}\n\nMITIGATION:\n{mitigation}\n\nIMPACT: {impact}"

# FIXED VALUES: the generic (first) fallback alert.
GENERIC_TEXT = (
    "THREAT: Suspicious activity detected on port {dst_port}\n\n"
    "Attack Details:\n"
    "• Protocol: {protocol}\n"
    "• Source Port: {src_port}\n"
    "• Destination Port: {dst_port}\n"
    "• Alert Type: {attack_type}\n\n"
    "MITIGATION:\n"
    "• Enable enhanced monitoring\n"
    "• Review security logs\n"
    "• Update security rules\n\n"
    "IMPACT: Potential security risk requiring investigation"
)

# FIXED VALUES: classifier prompt and summary prompt.
PROMPT_CLASSIFIER = ("Network Alert:\nProtocol: {protocol}\nSource Port: {src_port}\n"
                     "Destination Port: {dst_port}\nAttack Type: {attack_type}")
PROMPT_SUMMARY = (
    "\n"
    "        Network Alert:\n"
    "        - Protocol: {protocol}\n"
    "        - Source Port: {src_port}\n"
    "        - Destination Port: {dst_port}\n"
    "        - SLM Analysis: {slm_label} (Score: {slm_score})\n"
    "        - Binary Classification: {binary}\n"
    "        - Multi-class Classification: {attack_type}\n"
    "\n"
    "        Provide a **concise** summary of the detected threat:\n"
    "        - Type of attack (e.g., DDoS, Exploits).\n"
    "        - Suggested actions for mitigation.\n"
    "        - Implications for network security if unresolved.\n"
    "        "
)
