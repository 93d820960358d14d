"""Sentences filled with columns."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from lexmill.functions.text import particle

_SLOT = re.compile(r"\{(\w+)(?:/([^/}]+)/([^/}]+))?\}")


def say(sentence: str, **values: Column) -> Column:
    """The sentence with ``{name}`` replaced by a column; ``{name/A/B}`` adds the particle A after a final consonant, else B. A null value reads as ''."""
    parts: list[Column] = []
    at = 0
    for m in _SLOT.finditer(sentence):
        value = F.coalesce(values[m[1]].cast("string"), F.lit(""))
        parts += [F.lit(sentence[at : m.start()]), value]
        if m[2]:
            parts.append(particle(value, m[2], m[3]))
        at = m.end()
    return F.concat(*parts, F.lit(sentence[at:]))


# What a judgement says.
DETAIL = {
    "moved_here": "{clause} → {to} 로 이동(번호 변경). 인용 조문번호 수정 필요",
    "missing": "현행 법령에 {clause} 없음 (삭제/이동 의심) — 확인 필요",
    "no_day": "조례 시행일자 비교 불가",
    "amended": "{what/이/가} 조례 시행({own}) 이후 개정됨 ({gap}, {days}일 차) — 내용 변경, 검토 필요",
    "not_amended": "인용 {unit} 최종 개정일({now})이 조례 시행 이전 — 현행 정합",
    "unit_unsure": "{clause/은/는} 조례 시행 이후 개정(개정일 {now})됐으나 인용한 {unit}엔 개정 표기 없음 — 이 호의 변경 여부 확인 필요",
    "later_article": "개정이력 표기 없음이나 조문시행일({day})이 조례 이후 — 전부개정 가능성, 확인 필요",
    "no_history": "개정이력 없음·조문시행일 조례 이전 — 현행 정합",
    "renumbered": "{clause} 내용이 현행 {to} 로 이동(번호 변경) — 검토 필요",
    "deleted": "{clause/이/가} 현행 법령에서 사라짐(삭제/통합 의심) — 검토 필요",
    "nowhere": "{clause} 를 당시·현행 어디서도 못 찾음 — 확인 필요",
    "unit_same": "{clause/은/는} 조례 시행 이후 변경 없음(인용한 호·목 동일) — 현행 정합",
    "unit_changed": "{clause/이/가} 조례 시행({own}) 이후 개정됨 — 검토 필요",
    "tag_changed": "{clause/이/가} 조례 시행({own}) 이후 개정됨{gap} — 검토 필요",
    "tag_same": "{clause/은/는} 조례 시행 이후 개정 이력 없음(최종 개정 {now}) — 현행 정합",
    "text_same": "당시 조문과 현행 내용 동일 — 검토 불필요",
    "text_changed": "{clause} 내용이 조례 제정 당시와 달라짐(개정이력 표기 없음) — 검토 필요",
    "new_since": "{clause/은/는} 현행 법령에 존재(제정 당시본엔 없었으나 현재 유효) — 현행 정합",
    "rule_changed": "[행정규칙] 인용 조항이 조례 시행({own}) 이후 개정됨 (개정 시행 {day}) — 신구조문 대비상 내용 변경, 검토 필요",
    "rule": "[행정규칙] {detail}",
    "renamed": "인용한 「{law}」{law_particle} 현행 「{new}」{new_particle} 제명변경(개칭·통폐합)됨 — 법령 자체가 바뀌었으니 인용 법령명을 현행화하고 관련 조문을 전면 검토. (조문번호·내용이 재편됐을 수 있어 개별 조문 비교는 생략) [개칭 아니면 인용 오기 확인]",
    "local_rule": "지자체 자체 행정규칙 — 국가법령정보 API 미수록(자동 대조 불가), 원문 수기 확인 필요",
    "unresolved": "법령ID 미해결 (폐지/제명변경 의심)",
}

# What a finding asks to be done, by grade and kind of change.
ACTION = {
    "renamed": "「{law}」 법령명 불일치 — 인용 법령명 정정",
    "naked_only": '(서식만 정비) "{bare}"{bare_particle} "{quoted}"{quoted_particle} 정정 — 내용 변경은 없음 ({place})',
    "spacing_only": "(서식만 정비) 「{law}」 약칭을 앞말과 띄어 정정 ({place}) — 내용 변경은 없음, 띄어쓰기만 정비",
    "mechanical": "「{law}」 {clause} 인용을 현행 조문번호로 정정 ({place}) — {detail}",
    "내용변경": "「{law}」 {clause} 개정 내용을 반영하여 {place/을/를} 검토·정비",
    "삭제": "「{law}」 {clause} 삭제·통합 여부를 확인하고 {place}의 인용을 정비",
    "review": "「{law}」 {clause} 변경 사항을 검토하여 {place} 정비",
    "지자체행정규칙": "「{law}」는 지자체 자체 행정규칙 — 국가법령정보에 없어 자동 대조 불가. 자치법규정보시스템(ELIS, www.elis.go.kr)에서 최신 원문을 직접 확인해 {place} 인용을 정비",
    "법령미해결": "「{law}」 자동 매칭 실패 — 국가법령정보센터(법령·행정규칙)에서 현행 여부·명칭 확인. 중앙부처 행정규칙(훈령·예규·규정)이거나 제명변경·폐지일 수 있고, 지자체 자체 규칙이면 자치법규정보시스템(ELIS)에서 확인 — {place} 인용 정비",
    "당시부재": "「{law}」 {clause} 인용 시점을 확인 — {place} (제정 당시 부재)",
    "호미확인": "「{law}」 {clause}{unit} 변경 여부 확인 — {clause/은/는} 조례 시행 이후 개정됐으나 인용한 {which}엔 개정 표기가 없어 변경 여부 불명확({place})",
    "check": "「{law}」 {clause} 소재를 확인(삭제·이동·오기 여부) — {place}",
    "also_naked": " (덧붙여 「{law}」처럼 꺽쇠 서식으로 정정)",
    "also_spacing": " (덧붙여 약칭 앞 띄어쓰기 정정)",
    "nothing": "검토 완료 — 인용 조항이 조례 시행 이후 개정되지 않아 변경 없음.",
}
# The place a finding points at, a law without a name, an ordinance without a name or department.
PLACE, ANY_PLACE, NO_LAW_NAME, NO_NAME, NO_DEPT = "이 조례 {article}", "이 조례의 해당 조문", "(법령명 미상)", "(조례명 미상)", "(미지정)"
