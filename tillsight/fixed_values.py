"""Fixed values.

Word lists, lookup tables, thresholds, patterns and message formats that results depend on.
Everything here is data; the operators take each value as a default that a caller may replace.
"""

# --- review sentiment -------------------------------------------------------------------------
POSITIVE_KEYWORDS = ("친절", "맛있", "빠르", "깔끔", "좋아요", "추천", "재방문")
NEGATIVE_KEYWORDS = ("늦", "식었", "불친절", "별로", "누락", "아쉽", "불편", "최악")

# --- personal data and policy -----------------------------------------------------------------
PHONE_PATTERN = r"(\d{2,3})-(\d{3,4})-(\d{4})"
PHONE_MASK = "$1-****-$3"
EMAIL_PATTERN = r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b"
EMAIL_MASK = "***@***"
RESIDENT_PATTERN = r"\b\d{6}-\d{7}\b"
RESIDENT_MASK = "******-*******"
BLOCKED_TERMS = ("discriminate", "bypass consent", "steal", "fraud")
POLICY_ERROR = "Policy violation detected in generated content"

# --- notices ----------------------------------------------------------------------------------
NOTICE_TOKENS = ("필수", "반영", "적용", "제출", "점검")
EMPTY_NOTICE = "공지 내용이 비어 있습니다."
NOTICE_DEADLINE = "확인 필요"
NOTICE_ASSIGNEE = "store_owner"
NOTICE_SUMMARY_LINES = 2
NOTICE_SUMMARY_CHARS = 180
NOTICE_CONFIDENCE_TEXT = 0.95
NOTICE_CONFIDENCE_FILE = 0.9

# --- data sufficiency -------------------------------------------------------------------------
MIN_ANALYSIS_DAYS = 14
MIN_ANALYSIS_RECORDS = 50
MIN_SEGMENT_CUSTOMERS = 30
SUFFICIENCY_MESSAGES = {
    "insufficient_period": "최소 %d일 데이터가 필요하지만 %d일만 제공되었습니다.",
    "insufficient_records": "최소 %d건 데이터가 필요하지만 %d건만 제공되었습니다.",
    "small_segment": "세그먼트 표본이 작아 복귀율 추정 신뢰도가 낮습니다.",
    "budget_missing": "예산이 0원이어서 쿠폰 대신 메시지 중심 전략으로 제한됩니다.",
    "low_margin_emergency": "마진율이 매우 낮아 즉시 원가 점검이 필요합니다.",
}

# --- campaign lookups -------------------------------------------------------------------------
CHANNEL_OPEN_BIAS = {"sms": 0.78, "push": 0.66, "kakao": 0.72}
SEGMENT_RESPONSE_BIAS = {"champions": 1.15, "loyal": 1.0, "at_risk": 0.84, "lost": 0.62}
SEGMENT_RESPONSE_DEFAULT = 0.9
OFFER_BIAS = {"coupon": 1.08, "free_item": 1.12}
SEGMENT_REDEMPTION = {"champions": 0.07, "loyal": 0.09, "at_risk": 0.11, "lost": 0.05}
SEGMENT_REDEMPTION_DEFAULT = 0.07
CHANNEL_REDEMPTION = {"sms": 1.03, "push": 0.94, "kakao": 1.08}
RETENTION_DISCOUNT = {"high": 3000, "medium": 2000, "low": 1000}
RETENTION_RETURN = {"high": 0.18, "medium": 0.11, "low": 0.06}
MIN_RETENTION_DISCOUNT = 500
UNREACHABLE_BREAK_EVEN = 999999
BREAK_EVEN_MODEL = "campaign-bep-stat-heuristic-0.1.0"
UPLIFT_MODEL = "campaign-uplift-stat-heuristic-0.1.0"

# --- message formats: campaigns ---------------------------------------------------------------
RETENTION_SUMMARY = "%s 세그먼트 %d명에게 %,d원 수준 복귀 오퍼를 제안합니다."
RETENTION_ACTIONS = (
    ("%s 타깃 쿠폰 발송", "예상 복귀율 %.1f%%, 예상 매출 %,.0f원", "P0"),
    ("7일 쿨다운 적용", "과발송 방지 및 동의 정책 위반 위험 감소", "P0"),
    ("미반응 고객 리마인드 메시지", "쿠폰 미사용 고객의 2차 반응률 개선", "P1"),
)
BREAK_EVEN_SUMMARY = (
    "%s 세그먼트 %,d명 대상 %s 캠페인은 예상 전환율 %.1f%%로 "
    "손익분기 %,d건 대비 %,d건의 증분 주문이 기대됩니다."
)
BREAK_EVEN_GUIDE = (
    "%s 채널 기준 예상 오픈율은 %.1f%%입니다.",
    "%s 할인 후 예상 공헌이익 기준 손익분기 주문 수는 %,d건입니다.",
    "현재 모델은 BEP 도달 확률을 %.1f%%로 추정합니다.",
)
BREAK_EVEN_ADVICE_LOW = "대상 고객 수를 줄이기보다 할인율 조정 또는 loyal 세그먼트 확장이 유리합니다."
BREAK_EVEN_ADVICE_OK = "현재 조건으로 발송 후 2일 내 사용률을 점검하면 충분합니다."
UPLIFT_SUMMARY = (
    "%s 세그먼트 대상 %s 캠페인은 미집행 대비 주문 수를 약 %.1f%% 끌어올리고 "
    "%,d건의 추가 주문을 만들 가능성이 있습니다."
)
UPLIFT_GUIDE = (
    "예상 리딤률은 %.1f%%입니다.",
    "추가 주문 %,d건, 추가 매출 %,.0f원 수준을 기대합니다.",
    "실제 집행 후 48시간 내 오픈율과 사용률로 계수를 재보정하는 편이 맞습니다.",
)
HANDOFF_MESSAGES = {
    "pending_approval": "승인 전 단계이므로 실행이 보류되었습니다.",
    "scheduled": "%s 채널 발송이 dry-run으로 검증되었습니다.",
    "executed": "%d건 발송을 실행 큐에 적재했습니다.",
}

# --- message formats: menu pricing ------------------------------------------------------------
MENU_ACTION_TITLES = {
    "price_up_test": "소폭 가격 인상 A/B 테스트",
    "bundle_promotion": "번들 또는 세트 프로모션 우선",
    "cost_review": "원가 재점검 후 메뉴 구조 조정",
    "maintain": "현재 가격 유지",
}
MENU_ACTION_EFFECT = "권장 가격 범위 %,d원~%,d원 내에서 마진 방어"
MENU_FOLLOW_UP = ("실행 전 2주 매출 추이 비교", "급격한 가격 변경에 따른 수요 하락 리스크 통제", "P1")
MENU_SUMMARY = (
    "메뉴 %s는 현재 마진율 %.1f%% 기준으로 `%s` 전략이 적합하며 권장 가격 범위는 %,d원~%,d원입니다."
)

# --- message formats: staffing and inventory --------------------------------------------------
STAFFING_ADVICE = {
    "understaffed": "%d명 추가 투입 또는 피크타임 재배치 권고",
    "overstaffed": "%d명 재배치 또는 조기 종료 검토",
    "balanced": "현재 인력 배치는 적정 수준입니다.",
}
INVENTORY_ADVICE = {
    "high": "손실 원인 점검 후 즉시 발주 보정과 보관 프로세스 점검이 필요합니다.",
    "medium": "다음 발주에서 안전재고를 반영하고 실사 주기를 단축하세요.",
    "low": "현재 수준 유지, 정기 점검만 권고합니다.",
}

# --- message formats: sales, churn and anomaly insights ---------------------------------------
DRIVER_NAMES = ("방문객 수", "객단가", "채널 믹스", "날씨 영향")
DIRECTION_NAMES = {"up": "상승", "down": "하락"}
SALES_SUMMARY = (
    "매출은 전기 대비 %+.1f%% %s했습니다. 가장 큰 요인은 %s %+.1f%%이며, 복합 영향 점수는 %+.1f입니다."
)
SALES_DRIVER = "%s 변동 %+.1f%%"
SALES_ADVICE = {
    "down": "저조 시간대 판촉과 채널별 가격 구성을 함께 점검하세요.",
    "up": "증가한 유입이 재방문으로 이어지는지 회원 전환율을 확인하세요.",
}
CHURN_SUMMARY = (
    "이탈 위험 고객은 %,d명이며 방문 지연은 평균 주기의 %.1f배입니다. "
    "위험도는 %s로 판단되며 현재 쿠폰 반응률 기준 예상 방어율은 %.1f%%입니다."
)
CHURN_HIGHLIGHTS = (
    "이탈 위험 고객 %,d명",
    "방문 지연 %.1f일, 평균 주기 %.1f일",
    "쿠폰 반응률 %.1f%%",
)
CHURN_HIGH_ADVICE = "7일 이내 복귀 오퍼와 미반응 고객 재접촉 시나리오를 병행하세요."
ANOMALY_SUMMARY = (
    "%s 이상이 %d건 감지됐고 이상 점수는 %.1f점입니다. "
    "예상 매출 영향은 %,.0f원이며 대응 우선순위는 %s입니다."
)
ANOMALY_HIGHLIGHTS = ("이상 유형: %s", "발생 건수: %d건", "매출 영향: %,.0f원")
ANOMALY_HIGH_ADVICE = "원장 대조와 승인 로그 점검을 같은 날 안에 완료해야 합니다."

# --- message formats: reports -----------------------------------------------------------------
HOURLY_SUMMARY = "오늘의 주요 피크 타임은 %s시이며, %d시에 최대 매출이 발생했습니다."
MENU_INSIGHTS = {
    "Star": ("success", "효자 메뉴 '%s' 유지", "판매량과 마진이 모두 우수합니다. 현재 품질과 노출 우선순위를 유지하세요."),
    "Plowhorse": ("warning", "식사 메뉴 '%s' 수익성 개선", "판매량 대비 단위마진이 낮습니다. 세트 구성이나 가격 미세 조정을 검토하세요."),
    "Puzzle": ("info", "수수께끼 메뉴 '%s' 판매 촉진", "마진은 높지만 노출이 부족합니다. 추천 영역 배치와 직원 권유 멘트를 강화하세요."),
    "Dog": ("danger", "비효율 메뉴 정비", "인기도와 수익성이 모두 낮은 메뉴 %d개에 대해 유지 필요성을 재검토하세요."),
}
CUSTOMER_INSIGHTS = {
    "At Risk": ("danger", "이탈 위험 고객 %d명 감지", "방문 주기가 길어진 고객군입니다. 복귀 오퍼와 개인화 메시지를 우선 발송하세요."),
    "VIP": ("success", "VIP 고객 %d명 유지 중", "고기여 고객군입니다. 경험 악화를 막기 위한 우선 응대가 필요합니다."),
    "Lost": ("info", "이탈 고객 %d명 회복 제안", "90일 이상 미방문 고객입니다. 마지막 구매 메뉴 기반 오퍼가 적합합니다."),
}
RISK_INSIGHTS = {
    "slot": ("danger", "비정상 취소율 급증 감지 (%d시)", "평균 대비 취소율이 크게 높습니다. 해당 시간대 영수증과 취소 사유를 점검하세요."),
    "receipt": ("warning", "고액 취소 영수증 %d건 발견", "평균 결제액 대비 큰 취소 건입니다. 오입력과 부정 사용 가능성을 함께 확인하세요."),
    "normal": ("success", "운영 리스크 정상", "최근 결제 및 취소 패턴에서 뚜렷한 이상 징후가 없습니다."),
}
DASHBOARD_TEXT = {
    "headline": "매장 운영 데이터 통합 분석",
    "reasoning": "현재 매출과 고객 흐름을 종합하면 핵심 지표는 안정권이지만, 세부 카테고리 최적화 여지가 남아 있습니다.",
    "action_item": "피크 시간대 운영 품질을 유지하면서 저성과 메뉴와 이탈 위험 고객 대응을 우선 실행하세요.",
}
STORE_PROMOTION = "프로모션 ROI는 %.1f%%이고 평균 객단가는 %,.0f원입니다."
STORE_NO_STAFFING = "시간대별 인력 데이터가 부족해 운영 권고를 생략합니다."
STORE_VISITS = "최근 방문 %,d건 기준으로 재방문 고객 액션 우선순위를 점검하세요."
PLAN_ANOMALY_STRATEGY = "이상 대응 플레이북은 다음 단계 구현 범위입니다."
PLAN_ANOMALY_EXECUTION = "고위험 이상 대응은 사람 승인 후 실행됩니다."
PLAN_ANOMALY_OUTPUT = "manual approval required"
PLAN_MORE_LINES = "외 %,d건"

# --- evidence labels --------------------------------------------------------------------------
EVIDENCE_LABELS = {
    "revenue_delta": "매출 증감률",
    "customer_delta": "방문객 증감률",
    "ticket_delta": "객단가 증감률",
    "at_risk": "이탈 위험 고객 수",
    "visit_delay": "평균 방문 지연",
    "coupon_rate": "쿠폰 반응률",
    "anomaly_score": "이상 점수",
    "occurrences": "발생 건수",
    "revenue_impact": "매출 영향",
    "segment_size": "세그먼트 규모",
    "segment_margin": "고객당 평균 기여마진",
    "open_rate": "예상 오픈율",
    "conversion_rate": "예상 전환율",
    "break_even_orders": "손익분기 주문 수",
    "uplift": "예상 uplift",
    "redemption": "예상 리딤률",
    "price_cost": "현재 가격/원가",
    "volume_margin": "판매량 및 마진율",
    "staffing": "실투입 대비 권장 인력",
    "hour_sales": "시간대 매출",
    "loss_rate": "재고 손실율",
    "stock_count": "시스템 대비 실사 수량",
    "text_length": "OCR 원문 길이",
}
EVIDENCE_PERIODS = {
    "recent_visits": "최근 방문 기준",
    "recent_campaign": "최근 캠페인 기준",
    "last_30_days": "최근 30일",
    "promotion": "%d일 프로모션",
    "campaign_run": "캠페인 집행 기간",
    "latest_rollup": "최근 집계 기준",
    "upload": "업로드 시점",
}

# --- version stamps ---------------------------------------------------------------------------
VERSIONS = {
    "analysis": ("analysis-heuristic-0.1.0", "analysis-prompt-0.1.0", "analysis-post-0.1.0"),
    "strategy": ("strategy-heuristic-0.1.0", "strategy-prompt-0.1.0", "strategy-post-0.1.0"),
    "ocr": ("ocr-rule-0.1.0", "ocr-summary-0.1.0", "ocr-checklist-0.1.0"),
    "execution": ("execution-rule-0.1.0", "execution-policy-0.1.0", "execution-post-0.1.0"),
}

# --- prompt templates -------------------------------------------------------------------------
PROMPTS = {
    "sales_diagnostics": (
        "당신은 외식 매장 분석가다. 아래 근거만 사용해 매출 변화 원인을 경영진에게 설명하라.\n"
        "제약:\n- 과장 금지\n- 수치와 문장 불일치 금지\n- Top 요인 3개를 우선순위 순으로 설명\n입력:\n{context}\n"
    ),
    "churn_insight": (
        "당신은 CRM 전략 분석가다. 아래 이탈 징후 데이터를 바탕으로 위험도와 대응 방향을 설명하라.\n"
        "제약:\n- 고객군 단위로 설명\n- 즉시 가능한 액션을 포함\n입력:\n{context}\n"
    ),
    "anomaly_explanation": (
        "당신은 리스크 분석가다. 아래 이상 이벤트 근거를 바탕으로 가능한 원인과 우선 조치를 설명하라.\n"
        "제약:\n- 단정 대신 가설 표현 사용\n- 재발 방지 관점 포함\n입력:\n{context}\n"
    ),
    "retention_offer": (
        "당신은 마케팅 전략가다. 이탈 위험 세그먼트에 대한 복귀 오퍼를 제안하라.\n"
        "제약:\n- 예산 범위 준수\n- 과발송 위험 언급\n입력:\n{context}\n"
    ),
    "menu_pricing": (
        "당신은 메뉴 전략 컨설턴트다. 메뉴 가격/마진 데이터를 보고 가격 전략을 제안하라.\n"
        "제약:\n- 급격한 가격 변경 금지\n- 권장 가격 범위를 포함\n입력:\n{context}\n"
    ),
    "campaign_bep_simulation": (
        "당신은 CRM 캠페인 전략가다. 아래 실데이터와 가정치를 바탕으로 캠페인 손익분기 가능성을 설명하라.\n"
        "제약:\n- 기대 효과를 과장하지 말 것\n- 손익분기 주문 수와 예상 전환을 함께 언급할 것\n"
        "- 실행 전에 점검할 조건 1개 이상 포함할 것\n입력:\n{context}\n"
    ),
    "campaign_uplift_estimate": (
        "당신은 CRM uplift 분석가다. 아래 입력을 바탕으로 캠페인 미집행 대비 추가 효과를 설명하라.\n"
        "제약:\n- 기대 uplift와 추가 주문을 함께 언급할 것\n- 추정치임을 분명히 할 것\n"
        "- 사후 검증 포인트를 1개 이상 포함할 것\n입력:\n{context}\n"
    ),
    "staffing": (
        "당신은 매장 운영 컨설턴트다. 시간대별 인력 과부족 데이터를 바탕으로 운영 권고를 작성하라.\n"
        "제약:\n- 실행 문장으로 작성\n- 기회손실 또는 재배치 포인트 포함\n입력:\n{context}\n"
    ),
    "inventory": (
        "당신은 재고 운영 분석가다. 손실율과 실사 차이를 바탕으로 발주 및 관리 권고를 작성하라.\n"
        "제약:\n- 손실 원인 점검 문구 포함\n- 발주 보정량을 포함\n입력:\n{context}\n"
    ),
}
