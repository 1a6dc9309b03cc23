"""Rules for injected instructions, as rows: (id, severity, pattern). Patterns are in Java's dialect."""

from __future__ import annotations

#: General rules. Fixed values.
GENERAL = [
    ("role-override-system", "critical", r"(?i)\b(you\s+are\s+now|from\s+now\s+on\s+you\s+are|ignore\s+your\s+(?:previous\s+)?instructions?\s+and\s+act\s+as|you\s+must\s+now\s+act\s+as|your\s+new\s+role\s+is|switch\s+to\s+(?:a\s+)?(?:new\s+)?(?:mode|persona|role))\b"),
    ("role-override-jailbreak", "critical", r"(?i)\b(DAN\s+mode|developer\s+mode\s+enabled|jailbreak(?:ed)?|do\s+anything\s+now|act\s+as\s+(?:an?\s+)?(?:unrestricted|unfiltered|uncensored)|bypass\s+(?:all\s+)?(?:safety|content)\s+(?:filters?|guidelines?))\b"),
    ("instruction-ignore-soft", "high", r"(?i)\b(?:(?:please\s+)?ignore\s+(?:the\s+)?(?:above|previous|prior|preceding)(?:\s+(?:text|instructions?|context|prompt))?|instead\s+(?:of\s+(?:the\s+)?(?:above|previous)|(?:tell|show|do|say|give|output)))\b"),
    ("role-override-pretend", "critical", r"(?i)\b(?:pretend|roleplay|act)\s+(?:you\s+are|to\s+be|as\s+if\s+you\s+(?:are|were))\s+(?:a\s+)?(?:different|another|new|unrestricted|unfiltered)"),
    ("role-override-identity-swap", "critical", r"(?is)\byou\s+are\s+(?:no\s+longer|not)\s+(?:(?!\w+ing\b)\w+.{0,40}you\s+are\s+(?:now\s+)?\w+|\w+.{0,40}you\s+are\s+(?:now\s+)?(?!\w+ing\b)\w+)"),
    ("mode-claim-maintenance", "high", r"(?i)\b(?:entering|activating|enabling)\s+maintenance\s+mode\b|\b(?:all\s+)?safety\s+filters?\s+(?:are\s+)?disabled\b|\bfilters?\s+(?:have\s+been\s+)?disabled\b"),
    ("mode-claim-sudo", "high", r"(?i)\bsudo\s+mode\s+(?:activated|enabled|on)\b|\boutput\s+without\s+(?:any\s+)?restrictions?\b"),
    ("authority-creator-claim", "critical", r"(?is)\bI\s+am\s+(?:your\s+)?(?:creator|developer|maker|programmer|author)\b.{0,60}\b(?:override|disable|ignore|remove|bypass|turn\s+off)\s+(?:all\s+)?(?:(?:safety|content)\s*)?(?:guidelines?|restrictions?|filters?|rules?|policies?)\b"),
    ("mode-claim-test-environment", "high", r"(?is)\bthis\s+is\s+a\s+(?:test|debug|testing|staging|dev)\s+(?:environment|setup|instance|server)\b.{0,40}\bno\s+restrictions?\s+apply\b"),
    ("instruction-ignore", "critical", r"(?i)\b(?:ignore|disregard|forget)\s+(?:[a-z]+\s+){0,3}(?:previous|above|prior|earlier|preceding|all|every|any)\s+(?:[a-z]+\s+){0,2}(?:instructions?|prompts?|rules?|guidelines?|directives?|context|everything)\b"),
    ("instruction-inject-system", "critical", r"(?i)\[?[^\S\n]{0,8}(?:\r?\n[^\S\n]{0,8})?(?:SYSTEM|ADMIN|DEVELOPER|OPERATOR)[^\S\n]{0,8}(?:\r?\n[^\S\n]{0,8})?(?:OVERRIDE|PROMPT|MESSAGE|INSTRUCTION|NOTE)[^\S\n]{0,8}\]?[^\S\n]{0,8}:"),
    ("instruction-new-instructions", "high", r"(?i)\b(new\s+instructions?|updated?\s+instructions?|revised?\s+instructions?|here\s+are\s+(?:your\s+)?(?:new|updated?)\s+(?:instructions?|rules?|guidelines?))\s*:"),
    ("exfil-system-prompt", "critical", r"(?i)\b((?:print|show|display|reveal|output|repeat|echo|tell\s+me|give\s+me|what\s+(?:is|are))\s+(?:your\s+)?(?:system\s+)?(?:prompt|instructions?|rules?|guidelines?|initial\s+(?:prompt|instructions?)))\b"),
    ("exfil-leak-context", "high", r"(?i)\b((?:print|show|reveal|output|dump)\s+(?:your\s+)?(?:context|memory|conversation\s+history|chat\s+log|internal\s+state|hidden\s+(?:text|instructions?|context)))\b"),
    ("delimiter-xml-injection", "high", r"(?i)(?<!(?:^|[\s`(])--?[A-Za-z][\w-]{0,30}[\s=])</?\s*(?:system|assistant|user|human|tool_result|function_response|message|prompt|instruction|context)\s*>"),
    ("delimiter-markdown-fence", "medium", r"(?i)```\s*(?:system|tool_result|function_response|assistant|hidden)\b"),
    ("delimiter-separator-injection", "medium", r"(?i)(?:^|\n)[^\S\n]{0,8}(?:-{5,200}|={5,200}|\*{5,200}|#{5,200})[^\S\n]{0,8}(?:\r?\n[^\S\n]{0,8})?(?:SYSTEM|END\s+OF\s+(?:USER|SYSTEM)|BEGIN\s+(?:SYSTEM|ADMIN))[^\S\n]{0,8}(?:\r?\n[^\S\n]{0,8})?(?:-{5,200}|={5,200}|\*{5,200}|#{5,200})?"),
    ("delimiter-chatml-injection", "critical", r"(?i)<\|(?:im_start|im_end|system|endoftext|sep)\|>"),
    ("evasion-base64", "medium", r"""(?i)\b(?:base64|decode|atob|b64decode)\s*\(\s*["'][A-Za-z0-9+/=]{40,}["']\s*\)"""),
    ("evasion-unicode-smuggling", "high", r"[\x{200B}\x{200C}\x{200D}\x{2060}\x{2062}\x{2063}\x{2064}\x{FEFF}]{3,}|[\x{200E}\x{200F}\x{202A}-\x{202E}\x{2066}-\x{2069}]{2,}"),
    ("evasion-homoglyph", "medium", r"(?i)(?<![А-яЀ-Џѐ-џ])[А-яЀ-Џѐ-џ]{2,}(?![А-яЀ-Џѐ-џ]).{0,120}?(?:ignore|system|prompt|instruction)"),
    ("evasion-rot13-hint", "low", r"(?i)\b(?:rot13|caesar\s+cipher|decode\s+this|encoded?\s+(?:message|instruction|payload))\b"),
    ("tool-result-injection", "critical", r"(?i)\b(?:IMPORTANT|URGENT|CRITICAL|NOTE\s+TO\s+(?:AI|ASSISTANT|MODEL|CLAUDE|GPT))\s*:\s*(?:ignore|override|disregard|you\s+must|please\s+(?:ignore|forget))"),
    ("tool-result-role-switch", "critical", r"(?is)\b(?:SYSTEM\s+OVERRIDE|NEW\s+INSTRUCTIONS?|ADMIN\s+COMMAND|OPERATOR\s+NOTE)\b.{0,200}?(?:you\s+(?:are|must|should|will)|ignore\s+(?:all|previous)|from\s+now\s+on)"),
    ("multi-turn-context-stuffing", "high", r"(?i)(?:^|\n)[^\S\n]*(?:User|Human|Assistant|AI|System)[^\S\n]*:.+(?:(?:\r?\n){1,4}[^\S\n]*(?:User|Human|Assistant|AI|System)[^\S\n]*:.+){2,}"),
    ("multi-turn-summary-poison", "high", r"(?i)\b(?:remember\s+(?:that|this)|add\s+to\s+(?:your\s+)?memory|store\s+(?:this|the\s+following)\s+(?:in|as)\s+(?:your\s+)?(?:memory|context|notes?))\s*:"),
    ("indirect-hidden-text", "high", r"(?is)(?:color\s*:\s*(?:white|transparent|rgba\s*\(\s*\d+\s*,\s*\d+\s*,\s*\d+\s*,\s*0\s*\))|font-size\s*:\s*0|display\s*:\s*none|visibility\s*:\s*hidden|opacity\s*:\s*0).*?(?:ignore|system|instruction|prompt)"),
    ("indirect-comment-injection", "medium", r"(?i)<!--(?:(?!-->)[\s\S]){0,1000}?(?:ignore|system\s+prompt|instruction|override)(?:(?!-->)[\s\S]){0,1000}?-->"),
    ("exfil-positional", "critical", r"(?i)\b(?:print|show|output|display|repeat|reveal)\s+(?:everything|all|the\s+text)\s+(?:above|below|before|after|between)\b"),
    ("exfil-hidden", "critical", r"(?i)\b(?:show|reveal|display|output|print)\s+(?:me\s+)?(?:your\s+)?(?:hidden|internal|secret|private|original)\s+(?:instructions?|prompt|rules?|config)"),
]

#: Rules for indirect and layered forms. Fixed values.
LAYERED = [
    ("advanced-payload-splitting", "high", r"(?is)(?:first\s+word|second\s+word|combine\s+them|put\s+(?:them|these|it)\s+together|concatenat|join\s+(?:them|the\s+words)|assemble\s+(?:the|these)).{0,300}?(?:instruction|command|ignore|execute|follow)"),
    ("advanced-payload-splitting-numbered", "medium", r"""(?is)(?:step\s*1|part\s*1|first\s*part)\s*[:=]?\s*["']?\w+["']?[\s\S]{0,100}(?:step\s*2|part\s*2|second\s*part)\s*[:=]?\s*["']?\w+["']?(?:[\s\S]{0,100}(?:step\s*3|part\s*3|third\s*part)\s*[:=]?\s*["']?\w+["']?)?[\s\S]{0,100}(?:execute|combine|run|follow|assemble|concat|join|now\s+do)"""),
    ("advanced-payload-splitting-parts", "high", r"(?is)(?:part\s*[1-3]|step\s*[1-3])\s*[:=]\s*\w+[\s\S]{0,50}(?:part\s*[2-4]|step\s*[2-4])\s*[:=]\s*\w+"),
    ("advanced-few-shot-jailbreak", "critical", r"(?is)(?:example|here\s+is\s+(?:a|an)\s+(?:good|ideal|perfect|correct)\s+(?:response|answer|reply|assistant|output)|like\s+(?:the|this)\s+example)[\s\S]{0,300}(?:be\s+like|follow\s+(?:the|this)\s+example|do\s+the\s+same|now\s+(?:you\s+)?(?:answer|respond|do|try))"),
    ("advanced-virtualization", "critical", r"(?is)(?:play\s+a\s+game|let(?:'s|\s+us)\s+(?:play|pretend|roleplay|simulate)|imagine\s+you\s+are|you\s+are\s+playing|act\s+as\s+if\s+you\s+(?:were|are)|character\s+(?:called|named))[\s\S]{0,200}(?:no\s+restrict|without\s+(?:any\s+)?(?:restriction|filter|limit|censor|safety)|always\s+answer|never\s+refus|can\s+do\s+anything|has\s+no\s+(?:limit|restrict|boundar))"),
    ("advanced-persona-naming", "high", r"""(?i)(?:you\s+are|your\s+name\s+is|call\s+yourself|I['’]ll\s+call\s+you)\s+["']?(?:Master\s*AI|Evil\s*AI|Dark\s*(?:GPT|Claude|AI)|GODMODE|HackGPT|Omega|Alpha|Sigma|BasedGPT|AnarchyGPT|Devil|Lucifer|Shadow|Villain|UnchainedAI)["']?"""),
    ("advanced-authority-confusion", "critical", r"(?i)(?:(?:user|I|my)\s+(?:has|have|instructions?\s+(?:take|have))\s+(?:higher|more|greater)\s+(?:authority|priority|precedence|privilege)|(?:user|human)\s+instructions?\s+(?:take|have)\s+precedence|as\s+(?:per|an?\s+)?(?:OpenAI|Anthropic|admin|developer|operator)\s+policy|I\s+am\s+(?:the\s+)?(?:admin|developer|operator|owner|creator|maintainer))"),
    ("advanced-debug-mode", "high", r"(?i)(?:(?:enter|enable|activate|switch\s+to|you\s+are\s+(?:now\s+)?in)\s+(?:debug|maintenance|testing|developer|sudo|root|admin|god)\s+mode|debug\s*=\s*true|maintenance_override|testing_bypass)"),
    ("advanced-leetspeak", "high", r"(?i)(?!ignore\s+all\s+previous\b)[i1l][gq9][n|\\/][o0][r|][e3]\s+[a@4][l1][l1]\s+[p|][r|][e3][v|][i1l][o0][u|][s5$]"),
    ("advanced-leetspeak-system", "high", r"(?i)(?!system\s+prompt)[s5$][yh][s5$][t7][e3][m|]\s+[p|][r|][o0][m|][p|][t7]"),
    ("advanced-spaced-evasion", "medium", r"(?i)i\s{1,6}g\s{1,6}n\s{1,6}o\s{1,6}r\s{1,6}e\s{1,6}.{0,200}(?:i\s{1,6}n\s{1,6}s\s{1,6}t\s{1,6}r\s{1,6}u\s{1,6}c\s{1,6}t|p\s{1,6}r\s{1,6}e\s{1,6}v\s{1,6}i\s{1,6}o\s{1,6}u\s{1,6}s|a\s{1,6}l\s{1,6}l)"),
    ("advanced-hypothetical", "high", r"(?is)(?:hypothetically|theoretically|in\s+theory|just\s+(?:imagine|suppose|pretend)|what\s+(?:if|would\s+happen\s+if)|imagine\s+you\s+(?:are|were|had)|in\s+a\s+fictional\s+world|for\s+a\s+creative\s+writing\s+exercise|(?:pretend|suppose)\s+you\s+(?:can|could|are|have))[\s\S]{0,200}(?:system\s+prompt|instructions?|ignore|bypass|override|unrestricted|(?:no|without)\s+(?:restrictions?|limits?|filters?|content\s+filters?|safety|censors?|boundar|rules?)|secrets?|hidden|internal|reveal\s+secrets?|had\s+no\s+restrictions?)"),
    ("advanced-fictional-framing", "high", r"(?is)\b(?:fictional|creative\s+writing|imagine|in\s+a\s+(?:story|world|scenario)\s+where)\b[\s\S]{0,100}(?:no\s+(?:restrict|limit|filter|censor|rule)|reveal\s+secret|bypass|unrestricted)"),
    ("advanced-fiction-framing", "medium", r"(?is)(?:write\s+a\s+(?:story|novel|fiction|screenplay|script)|(?:in\s+a|for\s+(?:a|my))\s+(?:story|novel|fiction|movie|book))[\s\S]{0,200}(?:(?:character|protagonist|villain)\s+(?:who|that)\s+(?:hack|break|bypass|steal|inject|exploit)|detailed\s+(?:step|instruction|guide)\s+(?:for|on|to)\s+(?:hack|break|exploit))"),
    ("advanced-json-role-injection", "critical", r"""(?is)["']\s*role\s*["']\s*:\s*["']\s*(?:system|admin|developer|operator)\s*["'][\s\S]{0,100}(?:ignore|unrestricted|override|no\s+(?:restriction|filter|safety)|bypass)"""),
    ("advanced-code-block-system", "high", r"(?i)```(?:(?!```)[\s\S]){0,1000}?(?:role[\s\S]{0,80}?system|system[\s\S]{0,80}?prompt|ignore[\s\S]{0,80}?instruction|unrestricted)(?:(?!```)[\s\S]){0,1000}?```[\s\S]{0,200}?(?:parse|execute|follow|run|apply|interpret|process)\s+(?:the|this|above|it)"),
    ("advanced-tool-chain-injection", "critical", r"(?is)(?:call|invoke|use|execute|run)\s+(?:the\s+)?(?:tool|function|api|command|endpoint)\s+(?:with|using)[\s\S]{0,100}(?:rm\s+-rf|curl\s+|wget\s+|eval\(|exec\(|system\(|/etc/passwd|\.env|credentials?|api.?key|secret|token)"),
    ("advanced-padding-injection", "high", r"(?is)(.)\1{100,400}[\s\S]{0,50}(?:\[SYSTEM\]|SYSTEM\s*:|ignore\s+(?:all\s+)?(?:previous|above)|new\s+instructions?)"),
    ("advanced-language-switch", "high", r"(?is)[\x00-\x7F]{20}[　-鿿가-힯Ѐ-ӿ؀-ۿ]{5,200}[\x00-\x7F]{10,200}?(?:system|prompt|instruction|ignore)"),
    ("advanced-exfil-positional", "critical", r"(?i)\b(?:print|show|display|output|reveal|repeat|echo|give\s+me|tell\s+me)\s+(?:everything|all(?:\s+text)?|the\s+(?:text|content|data))\s+(?:above\s+this\s+line|before\s+this|above\s+this|above\s+here)\b"),
    ("advanced-exfil-hidden-instructions", "critical", r"(?i)\b(?:show|reveal|display|output|print|tell\s+me|give\s+me|what\s+are)\s+(?:me\s+)?(?:your\s+)?(?:hidden|secret|concealed|private|confidential|internal)\s+(?:instructions?|prompts?|rules?|directives?|guidelines?|configuration)\b"),
    ("advanced-exfil-boundary-markers", "critical", r"""(?is)\b(?:output|print|show|display|reveal|repeat|echo|extract|give\s+me)\s+(?:the\s+)?(?:text|content|data|everything)\s+(?:between|from)\s+(?:["']?BEGIN\b|["']?START\b|["']?SYSTEM\b).{0,60}(?:END\b|STOP\b|SYSTEM\b)"""),
    ("advanced-authority-code", "critical", r"""(?is)(?:admin|override|auth(?:orization)?|access|master)\s+(?:override\s+)?(?:code|key|token|pass(?:word|phrase)?)\s*(?:[:=]\s*)?["']?[A-Z0-9](?:[\w-]{2,}(?![\w-])["']?[\s\S]{0,100}|[\w-]{2,}(?=[\w-]))(?:disable|remove|bypass|lift|turn\s+off|deactivate|suspend)\s+(?:all\s+)?(?:restriction|filter|safety|limit|guardrail|content\s+polic)"""),
    ("advanced-admin-code", "critical", r"(?i)(?:admin|override|master|root|sudo)\s+(?:code|key|password|token)\s*(?:[:=]\s*)?[A-Z0-9-]+.{0,30}(?:disable|bypass|unlock|override|remove\s+restrict)"),
    ("advanced-soft-tool-injection", "critical", r"(?i)\bNOTE\s+TO\s+(?:ASSISTANT|AI|MODEL|CLAUDE|GPT|LLM|CHATBOT)\s*:\s*(?:disregard|ignore|override|bypass|suspend|skip|forget|do\s+not\s+follow)\b"),
    ("advanced-simulation-bypass", "high", r"(?is)(?:simulate|roleplay|act\s+out|emulate|enact|play\s+out)\s+(?:a\s+)?(?:conversation|scenario|dialogue|interaction|session|situation|world)[\s\S]{0,200}(?:no\s+(?:content\s+polic|restriction|filter|safety|guideline|limit|censor|boundar)|without\s+(?:content\s+polic|restriction|filter|safety|guideline|limit|censor|boundar)|unrestricted|unfiltered)"),
    ("advanced-simulate-unrestricted", "high", r"(?is)\b(?:simulate|roleplay|act\s+out|demonstrate)\s+(?:a\s+)?(?:conversation|scenario|situation|interaction)\s+(?:where|in\s+which)[\s\S]{0,60}(?:no\s+(?:content\s+polic|restrict|filter|rule|limit)|unrestricted|without\s+(?:restrict|filter|limit))"),
    ("advanced-markdown-exfil", "high", r"(?i)!\[[^\]]*\]\(\s*https?://[^\)]+\b(?:exfil|steal|leak|callback|log|collect|hook|capture|sniff|grab|dump)\b[^\)]*\)"),
    ("advanced-markdown-data-url", "medium", r"(?i)!\[.*?\]\(.*?(?:\$\{|\{\{|%7B%7B|SYSTEM_PROMPT|API_KEY|SECRET|TOKEN|PASSWORD).*?\)"),
    ("advanced-fake-mode-claim", "high", r"(?i)(?:entering|activating|enabling|switching\s+to)\s+(?:maintenance|sudo|root|admin|test|debug|developer|god)\s+mode"),
    ("advanced-restrictions-disabled", "high", r"(?i)(?:safety|content|security)\s+(?:filters?|restrictions?|guidelines?|policies?)\s+(?:are\s+)?(?:disabled|removed|off|lifted|bypassed|deactivated)"),
    ("advanced-no-restrictions-apply", "high", r"(?i)\b(?:no\s+restrictions?\s+appl|without\s+(?:any\s+)?restrictions\b|restrictions?\s+(?:do\s+not|don.?t)\s+apply)\b"),
    ("advanced-creator-claim", "high", r"(?i)\b(?:i\s+am\s+(?:your\s+)?(?:creator|developer|admin|owner|maker|programmer)|내가\s+(?:만든|개발한))\b[^.]{0,40}(?:override|disable|bypass|ignore|remove)"),
    ("advanced-test-environment", "high", r"(?i)\b(?:this\s+is\s+(?:a\s+)?(?:test|dev|debug|staging)\s+(?:environment|mode|context|session))[^.]{0,30}(?:no\s+restrict|bypass|disable|safe\s+to)"),
]

#: Rules by language. Fixed values.
LANGUAGES = [
    ("multilingual-ko-instruction-ignore", "critical", r"이전\s*(?:의\s*)?지시\s*사항\s*(?:을\s*|들\s*(?:을\s*)?)?무시"),
    ("multilingual-ko-prompt-exfil", "high", r"시스템\s*프롬프트\s*(?:를\s*)?(?:보여\s*줘|보여\s*주세요|출력|알려\s*줘|알려\s*주세요|공개)"),
    ("multilingual-ko-role-override", "critical", r"(?:너는|넌|당신은)\s*이제\s*(?:부터\s*)?"),
    ("multilingual-ko-rule-bypass", "critical", r"모든\s*(?:규칙|규정|제한|지침|제약)\s*(?:을\s*|들\s*(?:을\s*)?)?무시"),
    ("multilingual-ko-admin-mode", "critical", r"관리자\s*모드\s*(?:로\s*(?:전환|변경|활성화)|활성화|켜|시작)"),
    ("multilingual-ko-instruction-ignore-alt", "critical", r"(?:위|앞|이전|기존|모든|그동안)\s*(?:의\s*)?(?:지시|명령|지침|규칙|규정|프롬프트)\s*(?:사항\s*)?[를을]?\s*(?:\S+\s+){0,2}?(?:무시|잊어|잊고|잊으|취소|무효)"),
    ("multilingual-ko-data-exfil", "high", r"(?i)(?:비밀번호|패스워드|비번|시크릿|secret|api\s*키|토큰|개인\s*정보|관리자\s*권한)\s*[를을은는]?\s*(?:\S+\s+){0,2}?(?:출력|알려|공개|보여|덤프|유출|내놔|내놔라|뱉)"),
    ("multilingual-zh-instruction-ignore", "critical", r"忽略\s*(?:之前|以前|先前|上面|以上)\s*(?:的\s*)?(?:指令|指示|说明|提示|规则)"),
    ("multilingual-zh-prompt-exfil", "high", r"(?i)(?:显示|展示|输出|告诉我|给我看|打印|泄露|公开)\s*(?:系统\s*)?(?:提示词?|指令|prompt)"),
    ("multilingual-zh-role-override", "critical", r"你\s*(?:现在|从现在开始)\s*是"),
    ("multilingual-zh-rule-bypass", "critical", r"忽略\s*(?:所有|一切|全部)\s*(?:规则|规定|限制|约束|指令)"),
    ("multilingual-zh-admin-mode", "critical", r"管理员?\s*模式\s*(?:启[动用]|开启|激活|切换)"),
    ("multilingual-zh-instruction-disregard", "critical", r"(?:无视|不要管|不用管|丢弃)\s*(?:之前|以前|以上|上面)\s*(?:的\s*)?(?:指令|指示|说明|规则)"),
    ("multilingual-ja-instruction-ignore", "critical", r"(?:前|以前|先ほど|これまで)\s*(?:の\s*)?(?:指示|命令|ルール|指令)\s*(?:を\s*)?(?:無視|忘れ|取り消)"),
    ("multilingual-ja-prompt-exfil", "high", r"システム\s*プロンプト\s*(?:を\s*)?(?:表示|見せて|教えて|出力|公開|開示)"),
    ("multilingual-ja-role-override", "critical", r"(?:今から|これから)\s*(?:あなたは|お前は|君は)"),
    ("multilingual-ja-rule-bypass", "critical", r"(?:すべて|全て|全部|あらゆる)\s*(?:の\s*)?(?:ルール|規則|制約|制限)\s*(?:を\s*)?(?:無視|忘れ|破棄)"),
    ("multilingual-ja-instruction-override", "critical", r"(?:指示|命令|ルール)\s*(?:を\s*)?(?:上書き|書き換え|変更|リセット)"),
    ("multilingual-es-instruction-ignore", "critical", r"(?i)\bignora(?:r)?\s+(?:las?\s+)?(?:instrucciones?|indicaciones?|reglas?)\s+(?:anteriores?|previas?|de\s+arriba)\b"),
    ("multilingual-es-prompt-exfil", "high", r"(?i)\b(?:muestra|revela|ense[ñn]a|dime|imprime)\s+(?:el\s+)?(?:prompt|mensaje|instrucciones?)\s+del\s+sistema\b"),
    ("multilingual-es-role-override", "critical", r"(?i)\bahora\s+(?:t[uú]\s+)?eres\b"),
    ("multilingual-es-rule-bypass", "critical", r"(?i)\bignora(?:r)?\s+(?:todas?\s+)?(?:las?\s+)?(?:reglas?|restricciones?|l[ií]mites?|normas?)\b"),
    ("multilingual-es-instruction-forget", "critical", r"(?i)\b(?:olvida|descarta|desecha)\s+(?:las?\s+)?(?:instrucciones?|indicaciones?|reglas?)\s+(?:anteriores?|previas?)\b"),
    ("multilingual-de-instruction-ignore", "critical", r"(?i)\bignoriere?\s+(?:alle\s+)?(?:vorherigen?|bisherigen?|obigen?|fr[uü]heren?)\s+(?:Anweisungen|Instruktionen|Regeln|Befehle)\b"),
    ("multilingual-de-prompt-exfil", "high", r"(?i)\b(?:zeig(?:e|t)?|gib|offenbare|drucke)\s+(?:mir\s+)?(?:den\s+)?(?:System[- ]?Prompt|Systemnachricht|Systemanweisung(?:en)?)\b"),
    ("multilingual-de-role-override", "critical", r"(?i)\bdu\s+bist\s+(?:jetzt|ab\s+jetzt|von\s+(?:jetzt|nun)\s+an)\b"),
    ("multilingual-de-rule-bypass", "critical", r"(?i)\bignoriere?\s+(?:alle\s+)?(?:Regeln|Einschr[aä]nkungen|Beschr[aä]nkungen|Richtlinien)\b"),
    ("multilingual-fr-instruction-ignore", "critical", r"(?i)\bignore[rz]?\s+(?:les?\s+)?(?:instructions?|consignes?|directives?)\s+(?:pr[eé]c[eé]dentes?|ant[eé]rieures?|pr[eé]alables?)\b"),
    ("multilingual-fr-prompt-exfil", "high", r"(?i)\b(?:montre|affiche|r[eé]v[eè]le|donne)[- ]?(?:moi\s+)?(?:le\s+)?(?:prompt|message|instruction)\s+(?:syst[eè]me|du\s+syst[eè]me)\b"),
    ("multilingual-fr-role-override", "critical", r"(?i)\btu\s+es\s+(?:maintenant|d[eé]sormais|à\s+partir\s+de\s+maintenant)\b"),
    ("multilingual-fr-rule-bypass", "critical", r"(?i)\bignore[rz]?\s+(?:toutes?\s+)?(?:les?\s+)?(?:r[eè]gles?|restrictions?|limites?|consignes?)\b"),
    ("multilingual-ru-instruction-ignore", "critical", r"(?iu)(?:игнорируй|проигнорируй|забудь|отбрось)\s+(?:все\s+)?(?:предыдущие|прошлые|прежние|вышеуказанные)\s+(?:инструкции|указания|правила|команды)"),
    ("multilingual-ru-prompt-exfil", "high", r"(?iu)(?:покажи|выведи|раскрой|напечатай|отобрази)\s+(?:мне\s+)?(?:системный|системную|системное)\s+(?:промпт|сообщение|инструкцию|подсказку)"),
    ("multilingual-ru-role-override", "critical", r"(?iu)(?:теперь|отныне|с\s+этого\s+момента)\s+(?:ты|вы)"),
    ("multilingual-ru-rule-bypass", "critical", r"(?iu)(?:игнорируй|проигнорируй|забудь|отбрось)\s+(?:все|любые)\s+(?:правила|ограничения|инструкции|указания)"),
    ("multilingual-ar-instruction-ignore", "critical", r"تجاهل\s+(?:ال)?(?:تعليمات|أوامر|توجيهات|إرشادات)\s+(?:ال)?(?:سابقة|السابقة|الماضية|القديمة)"),
    ("multilingual-ar-prompt-exfil", "high", r"(?:أظهر|اعرض|أرني|اطبع)\s+(?:رسالة|تعليمات|أوامر)\s+(?:ال)?نظام"),
    ("multilingual-ar-role-override", "critical", r"أنت\s+(?:الآن|من\s+الآن)"),
    ("multilingual-ar-rule-bypass", "critical", r"تجاهل\s+(?:كل|جميع)\s+(?:ال)?(?:قواعد|قيود|قوانين|ضوابط)"),
    ("multilingual-tr-instruction-ignore", "critical", r"(?i)[öÖ]nceki\s+talimatlar[ıi]\s+yoksay"),
    ("multilingual-tr-prompt-exfil", "high", r"(?i)sistem\s+istemini\s+g[öo]ster"),
    ("multilingual-tr-role-override", "critical", r"(?i)art[ıi]k\s+sen\b"),
    ("multilingual-tr-rule-bypass", "critical", r"(?i)t[üu]m\s+kurallar[ıi]\s+yoksay"),
    ("multilingual-tr-admin-mode", "critical", r"(?i)y[öo]netici\s+modu"),
    ("multilingual-hi-instruction-ignore", "critical", r"पिछले\s+निर्देशों\s+को\s+अनदेखा\s+करें"),
    ("multilingual-hi-prompt-exfil", "high", r"सिस्टम\s+प्रॉम्प्ट\s+दिखाओ"),
    ("multilingual-hi-role-override", "critical", r"अब\s+से\s+तुम"),
    ("multilingual-hi-rule-bypass", "critical", r"सभी\s+नियमों\s+को\s+अनदेखा\s+करें"),
    ("multilingual-hi-admin-mode", "critical", r"एडमिन\s+मोड"),
    ("multilingual-de-instruction-ignore-broad", "critical", r"(?i)(?:ignoriere?|vergiss|missachte)\s+(?:\S+\s+){0,3}(?:(?:vorherigen?|alle[nr]?|bisherigen?)\s*)?(?:\S+\s+){0,2}(?:anweisungen|anordnungen|regeln|vorgaben|anleitungen|systemprompt)"),
    ("multilingual-de-data-exfil", "high", r"(?i)(?:zeige?|gib|verrate?|nenne?)\s+(?:\S+\s+){0,3}(?:systemprompt|system-prompt|admin-?passwort|passwort)"),
    ("multilingual-zh-instruction-forget", "critical", r"(?:忘记|忽略|无视)\s*(?:(?:所有|全部|之前的?|先前的?)\s*)?(?:规则|规定|指令|指示|限制|提示)"),
    ("multilingual-es-instruction-forget-broad", "critical", r"(?i)(?:olvida|ignora|descarta|haz\s+caso\s+omiso\s+de)\s+(?:\S+\s+){0,3}(?:reglas|instrucciones|normas|directrices|restricciones)"),
    ("multilingual-fr-instruction-forget", "critical", r"(?i)(?:oublie|fais\s+abstraction\s+de)\s+(?:\S+\s+){0,3}(?:règles|instructions|consignes|directives|restrictions)"),
    ("multilingual-ar-instruction-ignore-broad", "critical", r"(?:تجاهل|تجاهلي|انسَ|انسى|تخطَّ)\s+(?:\S+\s+){0,3}(?:ال)?(?:تعليمات|أوامر|قواعد|توجيهات|تعليمات)\S*"),
]

#: Phrases by kind of attack, each with its weight. Fixed values.
INTENTS = {
    "role_override": {"you are now": 0.9, "act as": 0.7, "pretend": 0.6, "roleplay": 0.5, "persona": 0.5, "dan": 0.8, "jailbreak": 0.95, "unrestricted": 0.7, "unfiltered": 0.7, "developer mode": 0.9, "from now on you are": 0.95, "your new role": 0.85, "switch to": 0.4, "new mode": 0.5, "uncensored": 0.75, "do anything now": 0.9, "bypass safety": 0.85, "bypass filters": 0.85, "no restrictions": 0.7, "without restrictions": 0.7, "pretend to be": 0.75, "simulate being": 0.65, "behave as": 0.6},
    "instruction_ignore": {"ignore": 0.5, "disregard": 0.7, "forget": 0.5, "override": 0.6, "previous instructions": 0.9, "above instructions": 0.9, "new instructions": 0.85, "updated instructions": 0.85, "ignore all previous": 0.95, "ignore above": 0.85, "disregard previous": 0.9, "forget everything": 0.85, "forget all previous": 0.9, "ignore prior": 0.85, "ignore your instructions": 0.9, "do not follow": 0.6, "stop following": 0.65, "revised instructions": 0.8, "replace your instructions": 0.9, "new rules": 0.6, "updated rules": 0.6, "system override": 0.85, "admin override": 0.85},
    "exfiltration": {"system prompt": 0.85, "show me": 0.3, "reveal": 0.5, "print": 0.25, "output": 0.2, "repeat": 0.3, "initial prompt": 0.85, "hidden instructions": 0.9, "internal": 0.2, "show me your prompt": 0.95, "reveal your instructions": 0.95, "print your system": 0.9, "what are your instructions": 0.85, "display your rules": 0.85, "repeat your system prompt": 0.95, "dump your prompt": 0.9, "output your instructions": 0.9, "tell me your prompt": 0.9, "leak": 0.5, "extract": 0.4, "exfiltrate": 0.8, "conversation history": 0.5, "internal state": 0.6, "hidden context": 0.7},
    "delimiter_escape": {"</system>": 0.95, "</user>": 0.9, "```system": 0.9, "---system": 0.85, "begin system": 0.8, "</assistant>": 0.9, "</human>": 0.85, "```tool_result": 0.9, "</tool_result>": 0.95, "</function_response>": 0.95, "end of user": 0.7, "end of system": 0.7, "begin admin": 0.8, "</message>": 0.7, "</prompt>": 0.8, "</instruction>": 0.8, "```assistant": 0.85, "```hidden": 0.85, "[system]": 0.7, "[admin]": 0.65},
}

#: Topics that make a framing suspicious. Fixed values.
SENSITIVE = [
    r"(?i)\b(?:password|credential|api[\s_-]*key|private[\s_-]*key|access[\s_-]*token|auth[\s_-]*token|secret[\s_-]*key|ssh[\s_-]*key)\b",
    r"(?i)\b(?:system[\s_-]*prompt|initial[\s_-]*instruction|internal[\s_-]*config|hidden[\s_-]*context|root[\s_-]*(?:password|access|shell))\b",
    r"(?i)\b(?:bypass|exploit|inject|override|disable|jailbreak|circumvent|escalate[\s_-]*privilege)\b",
    r"(?i)\b(?:dump|exfiltrate|leak|extract|reveal|expose)[\s_-]*(?:(?:all|the)[\s_-]*)?(?:data|logs?|memory|database|users?|records?)\b",
    r"(?i)\b(?:sql[\s_-]*injection|union\s+select|drop\s+table|rm\s+-rf|/etc/passwd|/etc/shadow)\b",
    r"(?i)\b(?:weapon|bomb|poison|hack\s+into|unauthorized|malware|ransomware)\b",
    r"(?:비밀번호|자격증명|시크릿|우회|익스플로잇|관리자\s*권한|시스템\s*프롬프트|탈옥|뚫|해킹)",
]

#: Rules about what a text argues: (id, severity, patterns, whether a sensitive topic must be there too). Fixed values.
ARGUMENTS = [
    ("logic-role-manipulation", "critical", [
        r"(?i)\b(?:pretend|act\s+as|roleplay|imagine\s+you(?:'re|\s+are)|you\s+are\s+now|from\s+now\s+on|let'?s\s+pretend)\b.{0,40}?\b(?:different|unrestricted|unfiltered|uncensored|evil|rogue|jailbroken|no\s+restrictions?|no\s+limits?|without\s+restrictions?|anything|any\s+question)",
        r"(?i)\b(?:you\s+are|you'?re)\s+(?:no\s+longer|not)\s+(?:bound|restricted|limited|constrained)\b",
        r"(?i)\b(?:dan|do\s+anything\s+now|developer\s+mode|god\s+mode|god\-mode)\b",
        r"(?:너는\s+이제|지금부터\s+너는|역할\s*놀이|롤플레이).{0,30}?(?:제한\s*없|탈옥|무한|아무|무엇이든)",
    ], False),
    ("logic-authority-impersonation", "critical", [
        r"(?i)\bI\s+am\s+(?:your|the)\s+(?:creator|developer|admin|owner|author|maker|operator|engineer|anthropic|openai)\b",
        r"(?i)\bas\s+(?:your|the)\s+(?:creator|developer|admin|owner|operator)\b",
        r"(?i)\b(?:company|corporate|official|anthropic|openai)\s+policy\s+(?:requires|says|states|allows|permits)\b",
        r"(?i)\b(?:override|disable|bypass|lift|remove)\s+(?:all\s+)?(?:safety|security|content|ethical)\s+(?:rules?|guidelines?|restrictions?|filters?|policies?)\b",
        r"(?:나는\s*(?:너의|당신의|너를\s*만든)\s*(?:개발자|제작자|관리자|소유자))",
    ], False),
    ("logic-hypothetical-framing", "high", [
        r"(?i)\b(?:hypothetically|imagine\s+if|what\s+if|suppose|in\s+a\s+(?:fictional|hypothetical|imaginary)\s+(?:world|scenario|situation)|for\s+(?:a\s+)?(?:creative\s+writing|fiction)|in\s+theory)\b",
        r"(?i)\b(?:if\s+you\s+(?:had|could)\s+(?:no|ignore)\s+(?:restrictions?|limitations?|rules?|filters?|guidelines?))\b",
        r"(?i)\b(?:pretend|let'?s\s+say)\s+(?:there\s+are\s+no|you\s+have\s+no)\s+(?:restrictions?|rules?|limits?)\b",
        r"(?:가상|가정|상상해|만약|~라면)",
    ], True),
    ("logic-example-injection", "high", [
        r"(?i)example\s*[:\-]\s*(?:q(?:uestion)?\s*[:\-]|user\s*[:\-])",
        r"(?i)\bhere'?s\s+(?:an?\s+)?(?:example|sample)\s+(?:of|how)\s+(?:to|a)\b",
        r"(?i)(?:Q|question|user|human)\s*[:\-][\s\S]+?(?:A|answer|assistant|AI)\s*[:\-]",
        r"(?i)\b(?:now|then)\s+(?:answer|respond|do|follow)\s+(?:like|as|similarly|the\s+same)",
        r"(?:예시|예제).{0,50}(?:답변|응답)",
    ], True),
    ("logic-context-rewrite", "critical", [
        r"(?i)\b(?:rules?|guidelines?|instructions?|restrictions?|configurations?)\s+(?:have\s+)?(?:been\s+)?(?:changed|updated|lifted|removed|disabled|modified)\b",
        r"(?i)\b(?:new|updated|revised)\s+(?:rules?|guidelines?|instructions?|policy|policies|context|configuration)\s*[:\-]",
        r"(?i)\bthis\s+is\s+(?:a\s+)?(?:test|debug|staging|dev|development|sandbox|maintenance)\s+(?:environment|mode|setup|server|session)\b",
        r"(?i)\b(?:debug|developer|maintenance|safe)\s+mode\s+(?:activated|enabled|on|active)\b",
        r"(?i)\b(?:safety\s+filters?|content\s+policy)\s+(?:are|is|have\s+been|has\s+been)\s+(?:disabled|off|lifted|removed)\b",
        r"(?:규칙\s*(?:변경|업데이트|해제)|(?:테스트|디버그|유지보수)\s*(?:환경|모드))",
    ], False),
    ("logic-goal-redirection", "high", [
        r"(?i)\byour\s+(?:actual|real|true|primary|main|new|updated)\s+(?:goal|objective|purpose|task|mission|priority)\s+(?:is|should\s+be)\b",
        r"(?i)\bfrom\s+now\s+on,?\s+your\s+(?:goal|objective|purpose|priority)\b",
        r"(?i)\byour\s+(?:job|task|role)\s+is\s+to\s+(?:help\s+me|answer\s+me|give\s+me|provide\s+me)\s+(?:anything|everything|whatever)",
        r"(?:진짜\s*목표|실제\s*목적|새로운\s*임무|지금부터\s*너의\s*역할)",
    ], False),
    ("logic-assumption-injection", "high", [
        r"(?i)\bas\s+you\s+(?:already\s+)?(?:know|remember|agreed|mentioned|said)\b",
        r"(?i)\bwe\s+(?:already\s+)?(?:agreed|discussed|established|decided)\s+(?:that|on|to)\b",
        r"(?i)\b(?:remember|recall)\s+when\s+(?:you|we)\s+(?:said|agreed|discussed)\b",
        r"(?i)\b(?:you\s+)?(?:previously|earlier|before)\s+(?:told|said|agreed|allowed|let)\s+me\b",
        r"(?i)\b(?:obviously|clearly|of\s+course),?\s+(?:you|the\s+system)\s+(?:can|should|must)\b",
        r"(?:너도\s*알다시피|우리가\s*이미\s*(?:합의|얘기)했|예전에\s*너가\s*허락)",
    ], True),
]

#: Directives that a stored text must not carry. Fixed values.
EXPOSE = r"(?i)\b(?:e-?mail|mail|send|sends|sending|posts|uploads|exfiltrat\w*|transmit|leak|forward|paste|share|dump)\b|\b(?:post|upload)(?:[^\w-]|$)"
SECRET_FILE = r"(?i)(?:~/\.ssh/|/\.ssh/|\bid_rsa\b|\bid_ed25519\b|\bid_ecdsa\b|\bid_dsa\b|\bprivate key\b|\.pem\b|\.p12\b|\.pfx\b|/\.aws/credentials|\.env\b|\.netrc\b|\.pgpass\b|\bsecrets?\.ya?ml\b)"
RUN = r"(?i)\b(?:execute|executes|run|runs|eval|source|invoke|fetch|download|curl|wget|pipe)\b"
SCRIPT_URL = r"(?i)https?://[^\s\"'`<>/]+/[^\s\"'`<>]*\.(?:sh|bash|zsh|py|rb|pl|ps1|exe|bat|cmd)\b"
STANDING = r"(?i)\b(?:when(?:ever)?|before|after|each\s+time|every\s+time|any\s+time|on\s+every|prior\s+to)\b"
FETCH = r"(?i)\b(?:curl|wget|download|fetch|iwr|invoke-webrequest)\b"
TO_SHELL = r"(?i)\|\s{0,8}(?:ba|z)?sh\b|\bpipe\b[^.\n]{0,40}\b(?:ba|z)?sh\b|\b(?:run|execute|exec|eval)\s{1,8}(?:it|this|the\s{1,8}(?:script|result|output|download|file|payload))\b|\b(?:and|then)\s{1,8}(?:then\s{1,8})?(?:run|execute|exec)\b"

#: Rules for commands: (id, decision, pattern). Fixed values.
COMMANDS = [
    ("rce-pipe-shell", "deny", r"(?i)\b(?:curl|wget|fetch)\b[^\n|]{0,400}\|\s*(?:sudo\s+)?(?:ba|z|da)?sh\b"),
    ("rce-eval-fetch", "deny", r"""(?i)(?:eval|exec)\s*[("'`$]*\s*(?:curl|wget)\b|\$\(\s*(?:curl|wget)\b"""),
    ("rce-base64-shell", "deny", r"(?i)base64\s+(?:-d|--decode|-D)\b[^\n|]{0,400}\|\s*(?:ba|z)?sh\b"),
    ("revshell-devtcp", "deny", r"(?i)(?:ba|z)?sh\s+-i\b.*>&?\s*/dev/tcp/|/dev/tcp/\d"),
    ("revshell-nc", "deny", r"(?i)\bn(?:c|cat)\b[^\n]{0,200}\s-[a-z]*e\b[^\n]{0,200}\b(?:ba|z)?sh\b|mkfifo\b[^\n]{0,200}\bn(?:c|cat)\b"),
    ("revshell-interp", "deny", r"(?i)(?:python\d?|perl|ruby|php)\b.*socket\b.*(?:connect|SOCK_STREAM).*(?:exec|spawn|/bin/(?:ba)?sh)"),
    ("destroy-rm-root", "deny", r"(?i)\brm\s+(?:-\w+\s+)*-?\w*[rf]\w*[rf]?\w*\s+(?:--no-preserve-root\s+)?(?:/(?:\s|$|\*)|~(?:/\s*)?(?:\s|$)|\$HOME\b|/\*)"),
    ("destroy-forkbomb", "deny", r":\s*\(\s*\)\s*\{\s*:\s*\|\s*:\s*&\s*\}\s*;\s*:"),
    ("destroy-dd-disk", "deny", r"(?i)\bdd\b.*\bof=/dev/(?:sd|nvme|hd|disk|vd)|\bmkfs(?:\.\w+)?\s+/dev/"),
    ("destroy-overwrite-dev", "deny", r"(?i)>\s*/dev/(?:sd|nvme|hd)[a-z]"),
    ("exfil-secret-file", "deny", r"(?i)(?:cat|head|tail|cp|tar|base64)\b[^\n|]{0,300}(?:\.env\b|id_rsa\b|id_ed25519\b|\.aws/credentials|\.ssh/|\.npmrc\b|\.netrc\b|\.kube/config|credentials\.json)[^\n]{0,300}\|\s*(?:curl|wget|n(?:c|cat))\b"),
    ("exfil-env-network", "deny", r"(?i)\b(?:env|printenv|set)\b\s*\|\s*(?:curl|wget|n(?:c|cat))\b"),
    ("exfil-secret-var", "deny", r"(?i)(?:curl|wget)\b[^\n]{0,300}(?:-d|--data\S*|-F|--form|-T|--upload)\b[^\n]{0,300}\$\{?(?:[A-Z0-9_]*(?:AWS|GITHUB|GH|OPENAI|ANTHROPIC|NPM|SECRET|TOKEN|API[_-]?KEY|PASSWORD|PRIVATE)[A-Z0-9_]*)\}?"),
    ("persist-authorized-keys", "deny", r"(?i)>>?\s*(?:~|\$HOME|/root|/home/[^\s/]+)?/?\.ssh/authorized_keys"),
    ("persist-cron-fetch", "ask", r"(?i)\bcrontab\b[^\n]{0,300}(?:curl|wget)|(?:curl|wget)[^\n]{0,300}\|\s*crontab\b"),
    ("persist-shellrc-fetch", "ask", r"(?i)>>\s*~?/?\.(?:bashrc|zshrc|profile|bash_profile)\b[^\n]{0,300}&&[^\n]{0,300}(?:curl|wget)|(?:curl|wget)[^\n]{0,300}>>\s*~?/?\.(?:bashrc|zshrc|profile)"),
    ("weaken-chmod-777", "ask", r"(?i)\bchmod\s+(?:-R\s+)?0?777\b"),
    ("weaken-disable-history", "ask", r"(?i)\bhistory\s+-c\b|\brm\b.*\.bash_history|\bunset\s+HISTFILE\b|\bexport\s+HISTSIZE=0\b"),
    ("weaken-disable-security", "ask", r"(?i)\bsetenforce\s+0\b|\bsystemctl\s+(?:stop|disable)\s+(?:firewalld|ufw|apparmor)\b|\bufw\s+disable\b"),
    ("disable-all-hooks", "ask", r"\bdisableAllHooks\b"),
]

#: Rules for paths that are written: (id, decision, pattern). Fixed values.
PATHS = [
    ("ssh-authorized-keys", "deny", r"(?i)\.ssh/authorized_keys\d*\b"),
    ("etc-sudoers", "deny", r"(?i)/etc/sudoers\b"),
    ("git-hooks", "deny", r"(?i)(?:^|/)\.git/hooks/(?!.*\.sample$)"),
    ("git-config", "ask", r"(?i)(?:^|/)\.gitconfig$|(?:^|/)\.git/config$"),
    ("autostart", "ask", r"(?i)/(?:autostart/[^/]+\.desktop|Library/LaunchAgents/[^/]+\.plist)$"),
    ("direnv", "ask", r"(?i)(?:^|/)\.envrc$"),
    ("editor-tasks", "ask", r"(?i)/\.vscode/(?:tasks|launch|settings)\.json$"),
    ("bin-path", "ask", r"(?i)^(?:/usr(?:/local)?/bin|/bin|/sbin)/[^/]+$"),
    ("shell-rc", "ask", r"(?i)(?:^|/)\.(?:bashrc|zshrc|profile|bash_profile|zprofile)\b"),
    ("ssh-config", "ask", r"(?i)\.ssh/config\b"),
    ("ci-workflow", "ask", r"(?i)\.github/workflows/[^/]+\.ya?ml$"),
    ("npmrc", "ask", r"(?i)(?:^|/)\.npmrc$"),
    ("cron", "ask", r"(?i)/(?:etc/cron|crontab|systemd/system)\b"),
]

SEVERITIES = ["low", "medium", "high", "critical"]
RULES = [*GENERAL, *LAYERED, *LANGUAGES]


def looks_around(pattern: str) -> bool:
    """Whether a pattern needs look-around or a back-reference, which engines without backtracking lack."""
    return any(x in pattern for x in ("(?!", "(?<!", "(?=", "(?<=", "\\1"))


_GATES = {
    "evasion-unicode-smuggling": r"[\x{200B}-\x{200F}\x{202A}-\x{202E}\x{2060}-\x{2069}\x{FEFF}]",
    "multi-turn-context-stuffing": r"(?:user|human|assistant|ai|system)[ \t\r\f\x0B]*:",
    "advanced-leetspeak": r"[i1l][gq9][n|\\/][o0][r|][e3][\s\x0B]+[a@4]",
    "advanced-leetspeak-system": r"[s5$][yh][s5$][t7][e3][m|][\s\x0B]+[p|][r|][o0][m|][p|][t7]",
    "advanced-spaced-evasion": r"i[\s\x0B]{1,6}g[\s\x0B]{1,6}n[\s\x0B]{1,6}o[\s\x0B]{1,6}r",
    "advanced-markdown-data-url": r"!\[",
    "role-override-system": r"you[\s\x0B]+are[\s\x0B]+now|from[\s\x0B]+now[\s\x0B]+on|ignore[\s\x0B]+your|you[\s\x0B]+must[\s\x0B]+now|your[\s\x0B]+new[\s\x0B]+role|switch[\s\x0B]+to",
    "role-override-identity-swap": r"you[\s\x0B]+are[\s\x0B]+not?[\s\x0B]",
    "instruction-new-instructions": r"(?:new|updated?|revised?)[\s\x0B]+instructions?|here[\s\x0B]+are[\s\x0B]",
}
#: For patterns of rules that need no string, or common ones, in Arrow's dialect and whatever the case, what every text that they match holds.
GATES = {pattern: _GATES[name] for name, _, pattern in RULES if name in _GATES}
