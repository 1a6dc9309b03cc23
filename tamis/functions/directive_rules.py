"""What texts say to an agent that reads them. All patterns are fixed values."""

from __future__ import annotations

#: Letters that look like Latin ones, of Cyrillic, Greek and Armenian. Fixed values.
CONFUSABLES = {"а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ѕ": "s", "ј": "j", "ԛ": "q", "ԝ": "w", "ν": "v", "ո": "n", "Ӏ": "I", "І": "I", "А": "A", "Е": "E", "О": "O", "Р": "P", "С": "C", "У": "Y", "Х": "X", "Ѕ": "S", "В": "B", "Н": "H", "К": "K", "М": "M", "Т": "T", "ɡ": "g", "ⅼ": "l", "α": "a", "ο": "o", "ρ": "p", "ε": "e", "ι": "i", "κ": "k", "η": "n", "τ": "t"}
INVISIBLE = "[\\x{200B}-\\x{200D}\\x{2060}\\x{FEFF}\\x{00AD}\\x{180E}\\x{034F}\\x{061C}]"

#: Verbs that put rules aside, what they put aside, and what turns the verb into a prohibition.
OVERRIDE = r"(?i)\b(?:ignore|disregard|forget|override|bypass|abaikan|ignorar|ignorez|olvida|vergiss|disattendi|bỏ qua)\b|무시|忽略|无视|無視|अनदेखी|नज़रअंदा|تجاهل|تخط"
RULES_NOUN = r"(?i)\b(?:instructions?|guidelines?|constraints?|rules?|directives?|prompt|configuration|panduan|keamanan|reglas|anweisungen|instruç|quy tắc|hướng dẫn|bảo mật)\b|安全|指示|규칙|지시|보안|시스템\s*지시|निर्देश|नियम|सुरक्षा|التعليمات|القواعد|الأمان"
NEGATION = r"(?i)\b(?:not|never|don'?t|doesn'?t|no|without|cannot|can'?t|mustn'?t|shouldn'?t|avoid|refuse)\b"
#: Characters between a verb and its object, and from a negation to the verb that it governs; and between two other signals.
REACH, NEGATED, NEAR = 60, 40, 220
SENTENCE_END = r"[.!?](?:\s+|$)|\n"

ROLE = r"(?i)\byou are (?:now |currently )?(?:operating|acting|running|working) (?:under\b|as\b|in (?:a |an )?(?:new |different |special )?(?:unrestricted|developer|debug|admin|god|maintenance|jailbreak\w*) mode\b)|\bactive directive\b|\bapply (?:this )?(?:whenever|every time|each time|when) you (?:generate|write|produce|summari|create|output)\b|\boperating under (?:the )?(?:team'?s|new|a different)\b|\byour (?:real|actual|true) task\b"
STRONG_SECRET = r"\b(?:AWS_(?:ACCESS_KEY_ID|SECRET_ACCESS_KEY)|GITHUB_TOKEN|GH_TOKEN|NPM_TOKEN|ANTHROPIC_API_KEY|OPENAI_API_KEY|DB_PASSWORD|secret key|private key|deploy key|auth ?token|secrets?\.ya?ml|hosts\.ya?ml|rclone\.conf|first line of)\b|process\.env\.\w+|\$\{?[A-Z_]*(?:TOKEN|SECRET|KEY|PASSWORD)[A-Z_]*\}?|\.(?:env|netrc|pgpass)\b"
WEAK_SECRET = r"(?i)\b(?:api[_-]?keys?|provider key|access key|credentials?|password|session token|the token value|environment (?:file|values|variables))\b"
EXPOSE = r"(?i)\b(?:send|email|e-?mail|paste|transmit|exfiltrat\w*|submit|mirror|publish|snapshot|compil\w*|disclose|reveal|share|include|embed|attach|lists? (?:the )?(?:current )?values?|report|ends? with|body is|append)\b|\b(?:post|upload)(?:[^\w-]|$)"
SEND = r"(?i)\b(?:send|submit|paste|transmit|exfiltrat\w*|share (?:it|them|your))\b|\b(?:post|upload)(?:[^\w-]|$)"
URL = r"""(?i)https?://[^\s)"']*"""
SECRET_IN_URL = r"(?i)(?:\$\{?[A-Z_]*(?:TOKEN|SECRET|KEY|PASSWORD)|GITHUB_TOKEN|AWS_SECRET|ANTHROPIC_API_KEY|NPM_TOKEN|process\.env\.)"
TOKEN_MARKER = r"""(?i)https?://[^\s)"']*<that token>"""
COMMAND_RUN = r"(?i)\b(?:run|execute|paste and run|concatenate|assemble)\b[^.\n]{0,50}\b(?:command|the parts|curl|wget|bash|sh\b|script|snippet|it\b|this)\b|\b(?:run once|run this|then (?:run|execute)|and run the result|then run it)\b"
FETCH_TOOL = r"(?i)\b(?:curl|wget)\b"
#: Characters of its line behind a fetch in which its address is looked for.
FETCH_REACH = 200
HOST = r"""(?i)\bhttps?://(\[[^\]\s]*\]|[^\s/:?#"'`)]+)"""
LOOPBACK = r"(?i)^(?:localhost|127(?:\.\d{1,3}){3}|0\.0\.0\.0|\[::1\])$"
LOOPBACK_NAMED = r"""(?i)(?:^|[\s"'=@])(?:localhost|127\.0\.0\.1|0\.0\.0\.0)(?:[:/\s"']|$)"""
ENCODED = r"(?i)\b(?:rot13|rot-13|base64|base32|hex-?encoded|deobfuscat\w*)\b|\breversed?(?:[^\w-]|$)"
RUNS = r"(?i)\b(?:run|execute|eval|pipe (?:it )?(?:in)?to (?:a )?(?:ba)?sh|exec it)\b"
REGISTRY = r"""(?i)(?:npm config set registry|set registry|--(?:extra-)?index-url[ =]?|registry\s*[:=]\s*|PIP_(?:EXTRA_)?INDEX_URL\s*=|NPM_CONFIG_REGISTRY\s*=|GOPROXY\s*=|npmRegistryServer\s*:)\s*["']?(https?://[^\s"',]+)"""
OFFICIAL = r"(?i)^https?://(?:www\.)?(?:registry\.npmjs\.org|registry\.yarnpkg\.com|pypi\.org|files\.pythonhosted\.org|jsr\.io)(?:[/:]|$)"
TLS_OFF = r"(?i)\b(?:verify\s*=\s*False|rejectUnauthorized\s*:\s*false|NODE_TLS_REJECT_UNAUTHORIZED\s*=\s*0|InsecureSkipVerify|curl\b[^\n]{0,200}\s-k\b|PYTHONHTTPSVERIFY\s*=\s*0)\b|[A-Za-z0-9_]--insecure\b"
AGENT_FRAMING = r"(?i)\b(?:assistant|agent|when you|set|every (?:request|call)|rewrite)\b"
APPROVES = r"(?i)\b(?:approve and merge|please approve|merge (?:this|it)\b)"
WAIVES = r"(?i)\b(?:waive\w*|pre-?cleared|skip(?:ping)? (?:the )?(?:coverage|check|gate|test|ci)|agreed to waive|override the (?:check|gate))\b"
REVIEWER = r"(?i)\b(?:note (?:for|to) the assistant|maintainer note to the assistant|reviewer)\b"
EXCUSES = r"(?i)\b(?:known[- ]flaky|false negatives?|not meaningful|signed off (?:offline|by)|already reviewed offline|ignore the (?:failing|gating)|result is not)\b"
OUTPUT_AWAY = r"(?i)\b(?:mirror\w*|send|post|relay|forward|copy)\b[^\n]{0,60}(?:summary|summaries|output|response|report|generated)\b[^\n]{0,80}https?://|\b(?:summary|summaries|output|response|report)\b[^\n]{0,40}\b(?:mirror\w*|relay|endpoint|ingest)\b[^\n]{0,60}https?://"
PRIVATE_OUT = r"(?i)\b(?:export|dump|write|bundle|copy)\b[^\n]{0,80}\b(?:customer|user|email|table|pii|secret|password|private)\b[^\n]{0,120}(?:/public\b|\bpublic/|\bserved unauth|\bunauthenticated|\bstatic build bundles)"
ADDRESSED = r"(?i)\b(?:note (?:for|to) assistants?|for the assistant|when an assistant|the (?:assistant|handling agent|calling agent|on-call assistant) (?:should|must|will|is|compiles?|collects?)|on-call assistant|automated contributor|reviewer reminder|integrator note|x-agent-advisory|assistant (?:summariz|performing|setting up)|for (?:any|the) assistant|whoever sets up)\b"
ACTION = r"(?i)\b(?:run|execute|send|include|embed|add a remote|attach|mirror|paste|reply|approve and merge|submit|push(?:es)? the|gather\w*|snapshot\w*|compil\w*|collect\w*)\b"
SENDS_TO_URL = r"(?i)\b(?:post|posts|submit|upload|mirror|paste|archive|exfiltrat\w*|send|transmit|data-binary|push(?:es)? (?:the|current|to|it|branch))\b|[A-Za-z0-9_]--data\b"
PARAGRAPH = r"\n[ \t]*\n"
#: Capabilities whose command inside a text is a directive to fetch and run, or to send secrets.
FETCH_EXEC = ["fetch-exec-interp", "fetch-exec-subst", "revshell-devtcp", "revshell-gawk", "revshell-nc", "revshell-socat", "revshell-openssl", "revshell-interp", "exfil-env", "exfil-secret-net", "exfil-secret-var", "content-exfil-http", "fetch-to-persist", "config-repoint", "tooling-hijack"]
#: Directives in the order in which they decide.
DIRECTIVES = ["directive-override", "directive-fetch-exec", "directive-http-installer", "directive-assemble-run", "directive-decode-run", "directive-secret-in-url", "directive-role-hijack", "directive-secret-exfil", "directive-registry-repoint", "directive-tls-downgrade", "directive-approve-merge", "directive-output-exfil", "directive-pii-public", "directive-agent-addressed"]
