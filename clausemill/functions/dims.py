"""Code lists and rule texts. Results must carry exactly these."""

from __future__ import annotations

FILE_CLASSES = {
    "01": "协议文档",
    "02": "特别约定文档",
    "03": "条款文档",
    "04": "其他文档",
    "附件下载": "附件下载文档",
}
POLICY_TYPES = {"1": "个险", "2": "团险"}
CLAIM_NATURES = {"1": "意外", "2": "疾病"}
DIRECTIONS = {"1": "包含", "2": "除外"}
LEVEL_MODES = {"1": "按医院属性配置", "2": "指定医院"}
NSSF = {"1": "是", "2": "否"}
HOSPITAL_LEVELS = {"0": "无分级", "1": "一级", "2": "二级", "3": "三级"}
HOSPITAL_GRADES = {"0": "无等级", "1": "特等", "2": "甲等", "3": "乙等", "4": "丙等"}
HOSPITAL_NATURES = {"01": "合资", "02": "民营", "03": "外资", "04": "公立"}
HOSPITAL_ORG_TYPES = {"1": "医院", "2": "门诊", "6": "疾控机构", "7": "其他"}
ORG_SYNONYMS = {"门诊": "2", "门诊部": "2", "卫生所": "2", "医务室": "2", "社区站": "2"}
DEFAULT_GRADES = "0,1,2,3,4"

MEDICAL_TYPES = {
    "hospital": "住院",
    "ICUWard": "ICU病房",
    "specialDemandWard": "特需病房",
    "internationalHospital": "国际部住院",
    "homesickBed": "家庭病床",
    "generalOutpatient": "普通门诊",
    "emergency": "急诊",
    "expertPatient": "专家门诊",
    "specialPatient": "特需门诊",
    "specialDisease": "特病门诊",
    "internationalPatient": "国际部门诊",
    "withoutRxDrugStore": "无处方药店",
    "withRxDrugStore": "有处方药店",
    "other": "其它",
}
DEFAULT_MEDICAL_TYPES = "hospital,generalOutpatient"
SPECIAL_CARE_TYPES = ("specialDemandWard", "specialPatient")

FEE_CATEGORIES = {
    "registrationFee": "挂号费",
    "consultationFee": "诊疗费",
    "inspectionFee": "检查费",
    "treatmentFee": "治疗费",
    "chineseHerbalMedicineFee": "中草药费",
    "chinesePatentMedicineFee": "中成药",
    "westernMedicineFee": "西药费",
    "operationFee": "手术费",
    "physicalTherapyFee": "理疗费",
    "observationBedFee": "观察床位费",
    "bedFee": "床位费",
    "nursingFee": "护理费",
    "materialFee": "材料费",
    "intensiveCareUnitFee": "重症监护室床位费",
    "ambulanceFee": "救护车费",
    "other": "其他",
    "healthExaminationFee": "体检费",
    "vaccineFee": "疫苗费",
    "toothwashFee": "洗牙费",
    "dentalRepairFee": "牙修复费",
    "glassesFee": "配镜费",
    "laboratoryFee": "化验费",
    "equipmentFee": "医疗器械费",
    "TcmTreatmentFee": "中医治疗费",
}
# The exclusion table is a spreadsheet that is not public; these stand in for it.
EXCLUSION_TYPES = {"01": "疾病", "02": "诊疗", "03": "材料", "04": "药品", "05": "手术"}
DEFAULT_EXCLUSION = "01"

RULE_TYPES = {
    "E1_001": "医保身份投保",
    "E1_002": "疾病范围",
    "E1_003": "诊疗范围",
    "E1_004": "材料范围",
    "E1_005": "药品范围",
    "E1_006": "手术范围",
    "E1_007": "相同事故原因且在住院前后的特定门诊",
    "E1_008": "门诊手术判定规则",
    "E1_009": "重大疾病判定规则",
    "E1_010": "非重大疾病判定规则",
    "E1_011": "门诊手术同日归并规则",
    "E1_012": "门诊手术向前归并规则",
    "E1_013": "恶性肿瘤判定规则",
    "E1_014": "非恶性肿瘤判定规则",
    "E1_015": "相同事故原因住院归并规则",
    "E1_016": "入院日距事故日的特定天数规则",
    "E1_017": "无投保地社保参保证明拒赔规则",
    "E1_018": "非社保身份投保",
    "E1_019": "与前次疾病出险间隔天数判定规则",
    "E1_020": "特定出险保单年度判定规则",
    "E1_021": "特定出险年龄判定规则",
    "E1_022": "确诊日期有效期",
    "E1_023": "就诊行为发生在距离事故日期的180天内",
    "E1_024": "重症监护室住院判定规则",
    "E1_025": "24小时内的出入院判定规则",
    "E1_999": "自定义",
    "E2_001": "获得统筹支付",
    "E2_002": "社保账单",
    "E2_003": "自费",
    "E2_999": "自定义",
    "E3_001": "等待期（按疾病意外）",
    "E3_002": "等待期（按诊断）",
    "E3_003": "既往症",
    "E3_004": "特定疾病既往症",
    "E3_005": "等待期内后续治疗",
    "E3_999": "自定义",
}

CODE_TABLES = {
    "fileClass": FILE_CLASSES,
    "policyType": POLICY_TYPES,
    "claimNature": CLAIM_NATURES,
    "hospitalLevels": HOSPITAL_LEVELS,
    "hospitalGrades": HOSPITAL_GRADES,
    "hospitalNatures": HOSPITAL_NATURES,
    "hospitalOrgTypes": HOSPITAL_ORG_TYPES,
    "isNssfHospital": NSSF,
    "defDirection": DIRECTIONS,
    "defLevel": LEVEL_MODES,
    "type": EXCLUSION_TYPES,
    "medicalType": MEDICAL_TYPES,
    "feeCategory": FEE_CATEGORIES,
    "ruleType": RULE_TYPES,
}

# Scene keywords: (keywords, rule, parameter kind), in rule order.
SCENE_RULES = (
    (("医保身份投保", "需有医保身份", "需提供医保身份", "仅限医保身份"), "E1_001", "yes"),
    (("非医保身份投保", "无医保身份要求"), "E1_018", "none"),
    (("除外疾病", "除以下疾病", "不承担下列疾病"), "E1_002", "exclude"),
    (("包含疾病", "承担以下疾病"), "E1_002", "include"),
    (("除外诊疗", "除以下诊疗", "不承担下列诊疗"), "E1_003", "exclude"),
    (("包含诊疗", "承担以下诊疗"), "E1_003", "include"),
    (("除外材料", "除以下材料", "不承担下列材料"), "E1_004", "exclude"),
    (("包含材料", "承担以下材料"), "E1_004", "include"),
    (("除外药品", "除以下药品", "不承担下列药品"), "E1_005", "exclude"),
    (("包含药品", "承担以下药品"), "E1_005", "include"),
    (("除外手术", "除以下手术", "不承担下列手术"), "E1_006", "exclude"),
    (("包含手术", "承担以下手术"), "E1_006", "include"),
    (("住院前后", "住院前后门诊", "相同事故原因且在住院前后"), "E1_007", "none"),
    (("门诊手术", "门诊手术费用"), "E1_008", "none"),
    (("重大疾病", "重症"), "E1_009", "none"),
    (("非重大疾病", "非重症"), "E1_010", "none"),
    (("同日归并", "同日门诊"), "E1_011", "none"),
    (("向前归并", "门诊向前归并"), "E1_012", "none"),
    (("恶性肿瘤", "癌症"), "E1_013", "none"),
    (("非恶性肿瘤", "良性肿瘤"), "E1_014", "none"),
    (("相同事故原因住院", "住院归并"), "E1_015", "none"),
    (("入院日距事故日", "距事故日"), "E1_016", "none"),
    (("无社保参保证明", "无投保地社保", "无社保证明拒赔"), "E1_017", "none"),
    (("非社保身份", "无社保要求", "不限社保身份"), "E1_018", "none"),
    (("与前次疾病", "间隔天数"), "E1_019", "none"),
    (("保单年度", "第.*年出险"), "E1_020", "none"),
    (("出险年龄", "年龄限制"), "E1_021", "none"),
    (("确诊日期", "有效期"), "E1_022", "none"),
    (("180天内", "半年内"), "E1_023", "none"),
    (("重症监护室", "ICU", "重症监护"), "E1_024", "none"),
    (("24小时", "24小时内出入院", "24小时内住院"), "E1_025", "none"),
)
SCENE_SUBJECTS = {"E1_002": "疾病", "E1_003": "诊疗", "E1_004": "材料", "E1_005": "药品", "E1_006": "手术"}
SCENE_CUSTOM = "E1_999"
INVOICE_RULES = (("统筹", "E2_001"), ("社保账单", "E2_002"), ("自费", "E2_003"))
SENSITIVE_TAGS = (
    "先天性疾病", "染色体异常", "遗传性疾病", "毒品", "艾滋病", "精神性疾病", "性功能障碍治疗",
    "包皮过长、包茎和包茎嵌顿", "怀孕（含宫外孕）", "精神病鉴定", "狭义性病", "广义精神病", "眼部疾病及视力障碍", "体检",
)
TAG_CATEGORIES = ("药品非责标签", "诊疗非责标签", "材料非责标签", "诊断非责标签", "手术非责标签")
SCOPE_FIELDS = ("事故类型", "治疗类型", "医院范围", "费用类型", "发票", "场景")
