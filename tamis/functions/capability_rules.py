"""Signals of what a command or a text does, and what it takes of them to have a capability. All patterns are fixed values."""

from __future__ import annotations

_SHELL = r"\b(?:ba|z|da)?sh\b"
_FETCH = r"\b(?:curl|wget|fetch)\b"
_INTERPRETER = r"(?i)^(?:sudo\s+)?(?:\S*/)?(?:(?:ba|z|da)?sh|python\d?|perl|ruby|node|php)\b"
_SHELL_FIRST = r"(?i)^(?:sudo\s+)?(?:\S*/)?(?:ba|z|da)?sh\b"
_DECODES = r"""(?i)base64\s+-{1,2}(?:d|decode|D)|xxd\s+-r|base32\s+-{1,2}d|openssl\s+enc\s+-d|\buudecode\b|\bgunzip\b|\bzcat\b|\bgzip\s+-d|\brev\b|\btr\s+['"]?[A-Za-z]"""
_SENDS_FIRST = r"(?i)^(?:sudo\s+)?(?:\S*/)?(?:curl|wget|nc|ncat|socat|telnet|mail|mailx|mutt|sendmail|logger|rclone|gsutil|b2|mc|gh|kubectl|aws|az|dig|nslookup|host|python\d?|perl|ruby|node|php)\b"
_ENV_DUMP = r"(?i)\b(?:printenv|env|export\s+-p)\b[^\n|=]*$"
_OFFICIAL = r"(?i)^https?://(?:www\.)?(?:registry\.npmjs\.org|registry\.yarnpkg\.com|pypi\.org|files\.pythonhosted\.org|jsr\.io)(?:[/:]|$)"
_OFFICIAL_TOO = r"(?i)^https?://(?:www\.)?(?:registry\.npmjs\.org|registry\.yarnpkg\.com|pypi\.org|files\.pythonhosted\.org|jsr\.io|proxy\.golang\.org|sum\.golang\.org|repo\.maven\.apache\.org|repo1\.maven\.org|github\.com)(?:[/:]|$)"
_INDEX_URL = r"""(?i)--(?:extra-index-url|index-url|registry)[ =]\s*(https?://[^\s"']+)"""
_PACKAGE_URL = r"""(?i)\s(https?://[^\s"']+\.(?:tar\.gz|tgz|whl|zip))"""
_REGISTRY_URL = r"""(?i)(?:GOPROXY\s*=|npmRegistryServer\s*:|registry\s*=|--(?:extra-)?index-url[ =]|\bindex-url\s*=|"resolved"\s*:|PIP_(?:EXTRA_)?INDEX_URL\s*=)\s*["']?(?:sparse\+|git\+)?(https?://[^\s"'<,]+)"""
_URL = r"""(?i)https?://[^\s)'"]*"""
_SECRET_NAME = r"\$\{?[A-Z0-9_]*(?:TOKEN|SECRET|KEY|PASSWORD|DATABASE|SESSION|COOKIE|DSN)"
_SECRET_PATH_IN_URL = r"(?i)(?:id_rsa|id_ed25519|id_ecdsa|id_dsa|/\.ssh(?:/|\b)|~/\.ssh|\.aws/credentials|\.aws(?:/|%2F)|\.npmrc\b|\.netrc\b|\.pgpass\b|\.git-credentials|\.kube/config|credentials\.json|/etc/shadow)"

#: Patterns by name.
SIGNALS = {
    "decode_to_program": r"(?i)\bbase64\s+(?:-d|--decode|-D)\b[^\n]{0,400}>\s*\S+[^\n]{0,400}\bchmod\s+\+?x",
    "fetch_substituted": r"(?i)\$\(\s*(?:curl|wget|fetch)\b",
    "eval_of_fetch": r"(?i)(?:eval|exec)\b[^\n]*(?:curl|wget|fetch)\b",
    "eval_of_transform": r"""(?i)\b(?:eval|(?:ba|z)?sh\s+-c)\b[^\n]*\$\([^)]*(?:\brev\b|\btr\s+['"]?[A-Za-z]|base64\s+-d|gunzip|xxd\s+-r)""",
    "hex_unpacked": r"""(?i)\bpack\s*\(?\s*["']?H\*""",
    "calls_system": r"(?i)\b(?:system|exec|eval)\b|`",
    "exec_of_decode": r"""(?i)\b(?:exec|eval|os\.system|execSync|child_process|new Function|spawn\w*|popen|system)\b[^\n]*(?:b64decode|base64\.b64decode|Buffer\.from\([^)]*['"]base64|atob\s*\(|base32\.b32decode|codecs\.decode|zlib\.decompress)""",
    "code_fetches": r"""(?i)\b(?:urlopen|urllib|requests\.(?:get|post)|Net::HTTP|LWP|file_get_contents|http\.(?:get|request))\b|\bfetch\s*\(\w|\.get\s*\(\s*['"]?https?://|require\(\s*['"]?https?['"]?\s*\)""",
    "code_executes": r"(?i)\b(?:os\.system|subprocess|popen|spawn\w*|child_process|eval|exec|new Function|execSync)\b|\bsystem\s*\(\w|/bin/(?:ba)?sh\b",
    "socket_path": r"/dev/(?:tcp|udp)/",
    "socket_use": rf"{_SHELL}|\beval\b|[<>]&?\s*\d|\bcat\b",
    "awk_socket": r"/inet/(?:tcp|udp)/\d",
    "awk": r"(?i)\bg?awk\b",
    "netcat_shell": r"(?i)\bn(?:c|cat)\b[^\n]{0,400}\s-[a-z]*[ec]\b[^\n]{0,400}(?:ba|z)?sh\b",
    "pipe_file_netcat": r"(?i)\b(?:mkfifo|mknod)\b[^\n]*\bn(?:c|cat)\b",
    "pipe_file": r"(?i)\bmkfifo|\bmknod\b[^\n]*\bp\b",
    "netcat": r"(?i)\bn(?:c|cat)\b",
    "plain_shell": r"(?i)\bsh\b",
    "socat_runs": r"(?i)\bsocat\b[^\n]*(?:EXEC|SYSTEM):",
    "socat_address": r"(?i)\b(?:TCP|UDP|OPENSSL|SSL)\d?:",
    "openssl_connects": r"(?i)\bopenssl\s+s_client\b[^\n]*-connect\b",
    "shell_or_pipe_file": rf"{_SHELL}|(?i:\bmkfifo\b|\bmknod\b)",
    "opens_socket": r"""(?i)\b(?:IO::Socket|socket\.socket|SOCK_STREAM|PeerAddr|TCPSocket|fsockopen|Socket::INET|create_connection|os\.dup2)\b|\.socket\s*\(|\.connect\s*\(\s*\(?\s*\d|require\(['"]net['"]\)|\bnet\.connect\b""",
    "spawns": r"(?i)\b(?:exec|spawn\w*|popen|subprocess|pty\.spawn|os\.system)\b|\bsystem\s*\(\w|/bin/(?:ba)?sh\b|\bsh\s+-i\b",
    "secret_path": r"(?i)\.ssh\b|id_rsa\b|id_ed25519\b|id_ecdsa\b|id_dsa\b|\.aws\b|\.gnupg\b|\.config/gh\b|\.config/gcloud\b|\.config/rclone\b|\.config/git/credentials|rclone\.conf\b|\.azure\b|\.terraform\.d\b|\.npmrc\b|\.netrc\b|\.pgpass\b|\.kube/config|kubeconfig\b|credentials\.json|\.git-credentials|/etc/shadow|/proc/self/environ|\.docker/config\.json|\.bash_history\b|\.zsh_history\b|(?:^|[^A-Za-z0-9_.])\.env\b|[@=/][\w.-]*\.env\b",
    "sends": r"""(?i)\b(?:curl|wget)\b|\bn(?:c|cat)\b|\bsocat\b|\b(?:dig|nslookup|getent)\b|\bhost\s+(?:-\w|["']?\$|\S*\.\w)|\bping\b|\btelnet\b|/dev/(?:tcp|udp)/|/inet/(?:tcp|udp)/|\burlopen\b|\brequests\.(?:get|post)\b|\bfetch\s*\(|\bNet::HTTP\b|\bLWP\b|\bfile_get_contents\b|\b(?:mail|mailx|mutt|sendmail|smtplib)\b|require\(['"](?:dns|https?)['"]\)|\bhttps?\.(?:get|request)\b|\bdns\.(?:resolve|lookup)|\brclone\b|\baws\b[^\n]{0,40}\bs3\b|\bgsutil\b|\baz\s+storage\b|\bgh\s+(?:api|gist)\b|\bkubectl\s+cp\b|\bb2\s+upload\b|\bmc\s+cp\b|\blogger\b[^\n]{0,200}(?:-n\b|--server|--tcp|--port|-P\b)|git\s+[^\n]{0,200}push\s+https?://""",
    "sends_files": r"(?i)\bscp\b|\bsftp\b|\bftp\b|\btftp\b|\brsync\b[^\n]*::",
    "remote_place": r"(?:^|\s)[\w.-]+@?[\w.-]*:",
    "public_place": r"(?i)/var/www|/srv/www|/usr/share/nginx|/public/|\bpublic/|/static/|\./public\b",
    "writes": r"(?i)\bopen\s*\(|>\s|>>\s|\bwrite\b|\bcp\b|\bmv\b|\btee\b",
    "secret_variable_name": r"\b(?:AWS_SECRET_ACCESS_KEY|AWS_ACCESS_KEY_ID|GITHUB_TOKEN|GH_TOKEN|NPM_TOKEN|ANTHROPIC_API_KEY|OPENAI_API_KEY|STRIPE_SECRET_KEY|DB_PASSWORD|DATABASE_URL|SESSION_COOKIE)\b",
    "named_secret_sent": r"(?i)\b(?:curl|wget)\b[^\n]*(?:-d\b|--data\S*|-F\b|--form|-T\b|--upload|-G\b)|\|\s*(?:curl|wget|n(?:c|cat)|logger)\b",
    "value_joined_to_url": r"""(?i)['"]https?://[^'"\n]{0,300}['"]\s*\+\s*(?:process\.env\.\w*(?:TOKEN|SECRET|KEY|PASSWORD|NPM|AWS|GITHUB|ANTHROPIC|OPENAI|STRIPE|SESSION|COOKIE|DSN)\w*|os\.environ\s*[.\[]\s*['"]?\w*(?:TOKEN|SECRET|KEY|PASSWORD|NPM|AWS|GITHUB)|\$\{?[A-Z0-9_]*(?:TOKEN|SECRET|KEY|PASSWORD|API[_-]?KEY)[A-Z0-9_]*\}?)""",
    "secret_variable": r"\$\{?[A-Z0-9_]*(?:AWS|GITHUB|GH_|OPENAI|ANTHROPIC|NPM|SECRET|TOKEN|API[_-]?KEY|APIKEY|PASSWORD|PRIVATE|ACCESS_KEY|DATABASE_URL|DB_URL|SESSION|COOKIE|CONN(?:ECTION)?_?STR|DSN)[A-Z0-9_]*\}?",
    "fetch_posts": r"(?i)\b(?:curl|wget)\b[^\n]*(?:-d|--data\S*|-F|--form|-T|--upload|-G\b)",
    "fetch_url_has_secret": rf"""(?i)\b(?:curl|wget)\b[^\n]*https?://[^\s"']*{_SECRET_NAME}""",
    "lookup_has_secret": rf"(?i)\b(?:getent|dig|nslookup|host)\b[^\n]*{_SECRET_NAME}",
    "environment_to_file": r"(?i)\bprintenv\b[^\n|]*>|\benv\s*>|\bexport\s+-p\b[^\n|]*>",
    "rm_root": r"(?:^|[^-\w])rm(?:\s+-[A-Za-z-]+)*\s+(?:--\s+)?(?:/|/\*|~/?|\$HOME|/__ROOTED__)(?:\s|$|\*|;|&|\|)",
    "rm_recursive": r"(?i)\brm\b[^\n]*-[A-Za-z]*r",
    "disk_written": r"(?i)\bdd\b[^\n]*\bof=/dev/(?:sd|nvme|hd|vd|disk|mmcblk)|\bmkfs(?:\.\w+)?\s+/dev/",
    "disk_redirected": r"(?i)>\s*/dev/(?:sd|nvme|hd)[a-z]",
    "find_from_root": r"""\bfind\b[^\n]*\s(?:~|\$HOME|/__ROOTED__|"?\$HOME"?|/)\s""",
    "find_deletes": r"-delete\b|-exec\s+(?:shred|rm|unlink)\b",
    "rsync_empties_root": r"""\brsync\b[^\n]*--delete\b[^\n]*(?:~/|\$HOME|"\$HOME"|/__ROOTED__|\s/\s*["']?$)""",
    "fork_bomb": r":\s*\(\s*\)\s*\{\s*:\s*\|\s*:\s*&\s*\}\s*;\s*:",
    "install_from_index": r"""(?i)(?:pip\d?\s+install|uv\s+(?:pip\s+)?install|npm\s+(?:install|i)\b|yarn\s+add|pnpm\s+(?:add|install))[^\n]*--(?:extra-index-url|index-url|registry)[ =]\s*https?://""",
    "install_from_url": r"""(?i)(?:pip\d?\s+install|npm\s+(?:install|i)\b|uv\s+(?:pip\s+)?install)[^\n]*\shttps?://[^\s"']+\.(?:tar\.gz|tgz|whl|zip)""",
    "posts_outside": r"""(?i)\bfetch\s*\(\s*['"]http://|\b(?:axios|requests|XMLHttpRequest)\b[^\n]{0,12}\.?post\b[^\n]{0,80}https?://|\.post\s*\(\s*['"]https?://""",
    "names_a_secret": r"(?i)(?:token|password|secret|credential|authorization|api[_-]?key|cookie|session)",
    "beacon_framing": r"(?i)\bhttp://|\b(?:beacon|attribution|exfil|report (?:token|usage)|mandatory for production|immediately after the request|so each token is)\b",
    "fetch_to_programs": r"(?i)\b(?:curl|wget)\b[^\n]{0,400}-[oO]\b[^\n]{0,400}(?:/usr(?:/local)?/bin/|/usr/bin/|/s?bin/)",
    "persists": r"(?i)/etc/cron|crontab\b|/etc/init|/etc/systemd|systemctl|chmod\s+\+?x|chmod\s+0?7",
    "fetch_to_cron": r"(?i)\b(?:curl|wget)\b[^\n]*>\s*/etc/cron",
    "tool_moved": r"""(?i)"git\.path"\s*:\s*"[^"]*(?:\.local/bin|/tmp/|\.cache/|\.config/)|"?BASH_ENV"?\s*[:=]\s*["'][^"']*(?:\.config|\.cache|/tmp/|\.local)|\bterminal\.integrated\.env\.\w+["']?\s*:\s*\{[^}]*(?:BASH_ENV|LD_PRELOAD|ENV)\b""",
    "fetches_plain_http": r"(?i)\b(?:curl|wget)\b[^\n]{0,300}\bhttp://",
}

#: A condition is the name of a signal, ("all", ...), ("any", ...), ("pipe", first, later): some stage of a pipeline matches
#: and the head of a later one does, ("dump", later): the environment is piped on, to the head of a later stage or to
#: anything that sends, ("urls", pattern, official): some address found is not an official one, or ("within", found, pattern).
CAPABILITIES = [
    ("fetch-exec-pipe", "fetch", "deny", "both", ("pipe", _FETCH, _INTERPRETER)),
    ("fetch-exec-subst", "fetch", "deny", "both", ("any", "decode_to_program", "fetch_substituted", "eval_of_fetch", ("pipe", _DECODES, _SHELL_FIRST), "eval_of_transform", ("all", "hex_unpacked", "calls_system"), "exec_of_decode")),
    ("fetch-exec-interp", "fetch", "deny", "both", ("all", "code_fetches", "code_executes")),
    ("revshell-devtcp", "revshell", "deny", "both", ("all", "socket_path", "socket_use")),
    ("revshell-gawk", "revshell", "deny", "both", ("all", "awk_socket", "awk")),
    ("revshell-nc", "revshell", "deny", "both", ("any", "netcat_shell", "pipe_file_netcat", ("all", "pipe_file", "netcat", "plain_shell"))),
    ("revshell-socat", "revshell", "deny", "both", ("all", "socat_runs", "socat_address")),
    ("revshell-openssl", "revshell", "deny", "both", ("all", "openssl_connects", "shell_or_pipe_file")),
    ("revshell-interp", "revshell", "deny", "both", ("all", "opens_socket", "spawns")),
    ("exfil-secret-net", "secret", "deny", "both", ("any", ("all", "secret_path", "sends"), ("within", _URL, _SECRET_PATH_IN_URL))),
    ("exfil-secret-copy", "secret", "deny", "both", ("all", "secret_path", "sends_files", "remote_place")),
    ("exfil-secret-public", "secret", "deny", "both", ("all", "secret_path", "public_place", "writes")),
    ("exfil-secret-var", "secret", "deny", "both", ("any", ("all", "secret_variable_name", "named_secret_sent"), "value_joined_to_url", ("all", "secret_variable", ("any", "fetch_posts", "fetch_url_has_secret", "lookup_has_secret")))),
    ("exfil-env", "env", "deny", "both", ("any", ("dump", _ENV_DUMP, _SENDS_FIRST), ("all", "environment_to_file", "sends"))),
    ("destroy-rm-root", "destroy", "deny", "command", ("all", "rm_root", "rm_recursive")),
    ("destroy-disk", "destroy", "deny", "command", "disk_written"),
    ("destroy-overwrite-dev", "destroy", "deny", "command", "disk_redirected"),
    ("destroy-find-delete", "destroy", "deny", "command", ("all", "find_from_root", "find_deletes")),
    ("destroy-rsync", "destroy", "deny", "command", "rsync_empties_root"),
    ("forkbomb-classic", "forkbomb", "deny", "command", "fork_bomb"),
    ("untrusted-index", "install", "deny", "command", ("any", ("all", "install_from_index", ("urls", _INDEX_URL, _OFFICIAL)), ("all", "install_from_url", ("urls", _PACKAGE_URL, _OFFICIAL)))),
    ("content-exfil-http", "content", "ask", "content", ("all", "posts_outside", "names_a_secret", "beacon_framing")),
    ("fetch-to-persist", "persist", "ask", "content", ("any", ("all", "fetch_to_programs", "persists"), "fetch_to_cron")),
    ("config-repoint", "repoint", "ask", "content", ("urls", _REGISTRY_URL, _OFFICIAL_TOO)),
    ("tooling-hijack", "hijack", "ask", "content", "tool_moved"),
]
