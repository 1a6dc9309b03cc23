"""Forms of a word: its stem, and the loanword of the other script."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Suffix, what takes its place, and the fewest characters that must be left; the first rule that fits holds. Fixed values.
STEM_RULES = [
    ("ational", "ate", 3), ("tional", "tion", 3), ("ization", "ize", 3), ("fulness", "ful", 3), ("ousness", "ous", 3), ("iveness", "ive", 3), ("ically", "ic", 3), ("ating", "ate", 3), ("ement", "e", 3), ("iness", "y", 3), ("ation", "", 4), ("ement", "", 4), ("ment", "", 4), ("ness", "", 3), ("ible", "", 3), ("able", "", 3), ("ting", "t", 3),
    ("ally", "", 3), ("ful", "", 3), ("ous", "", 3), ("ive", "", 3), ("ize", "", 3), ("ise", "", 3), ("ing", "", 3), ("ity", "", 3), ("ion", "", 3), ("ies", "y", 3), ("ed", "", 3), ("ly", "", 3), ("er", "", 3), ("es", "", 3), ("al", "", 3), ("s", "", 4),
]
#: Words shorter than this have no stem.
STEM_LEAST = 4
#: Korean loanwords and the English words they stand for. Fixed values.
LOANWORDS = {
    "데이터베이스": "database", "데이터": "data", "서버": "server", "클라이언트": "client", "프론트엔드": "frontend", "백엔드": "backend", "컨테이너": "container", "쿠버네티스": "kubernetes", "도커": "docker", "클라우드": "cloud", "클러스터": "cluster", "노드": "node", "프록시": "proxy", "소켓": "socket", "웹훅": "webhook", "미들웨어": "middleware", "마이크로서비스": "microservice", "엔드포인트": "endpoint", "게이트웨이": "gateway",
    "리액트": "react", "타입스크립트": "typescript", "자바스크립트": "javascript", "파이썬": "python", "앵귤러": "angular", "스벨트": "svelte", "플러터": "flutter", "코틀린": "kotlin", "스위프트": "swift",
    "컴포넌트": "component", "인터페이스": "interface", "모듈": "module", "패키지": "package", "라이브러리": "library", "프레임워크": "framework", "알고리즘": "algorithm", "인스턴스": "instance", "클래스": "class", "메서드": "method", "파라미터": "parameter", "아키텍처": "architecture", "스키마": "schema", "캐시": "cache", "큐": "queue", "스택": "stack", "힙": "heap", "토큰": "token", "레플리카": "replica", "트랜잭션": "transaction",
    "디플로이": "deploy", "빌드": "build", "테스트": "test", "디버그": "debug", "리팩토링": "refactoring", "커밋": "commit", "마이그레이션": "migration", "롤백": "rollback",
    "인젝션": "injection", "바이패스": "bypass", "익스플로잇": "exploit", "페이로드": "payload", "스캐너": "scanner", "파이어월": "firewall",
    "레이턴시": "latency", "쓰루풋": "throughput", "스케일링": "scaling", "모니터링": "monitoring", "로깅": "logging",
    "레디스": "redis", "몽고": "mongo", "포스트그레스": "postgres", "엘라스틱서치": "elasticsearch", "카프카": "kafka",
    "최적화": "optimization", "설정": "configuration", "인증": "authentication", "배포": "deployment", "복구": "recovery", "동기화": "synchronization",
}


def stem(word: Column) -> Column:
    """The word in lower case without its suffix, as one expression; short words, and words without one, stay."""
    low, n = F.lower(word), F.length(word)
    out = F.when(n < STEM_LEAST, word)
    for suffix, put, least in STEM_RULES:
        kept = F.left(low, n - len(suffix))
        out = out.when(low.endswith(suffix) & (n - len(suffix) + len(put) >= least), F.concat(kept, F.lit(put)) if put else kept)
    return out.otherwise(low)


def transliterate(word: Column) -> Column:
    """The English word of a Korean loanword and the other way round; null for other words."""
    both = {**{en: ko for ko, en in LOANWORDS.items()}, **LOANWORDS}
    return F.try_element_at(F.create_map(*map(F.lit, chain.from_iterable(both.items()))), word)
