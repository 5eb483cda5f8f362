"""Header vocabularies, markers and file-name rules.

Results depend on these exact strings and on their order.
"""

# --- column header words -----------------------------------------------------
PART_NO = [
    "零件号", "零部件件号", "零件编码", "物料编码", "件号", "物料号", "料号", "零部件代号", "代号",
    "代码", "编码", "物料代码", "零件号(中文）", "零件号(中文)", "零件号（中文）",
    "part no", "partno", "part number", "part_no", "part#", "part number(中文）",
    "part number(中文)", "item code", "material code", "material no", "material number",
    "component code", "component number", "code",
    "код детали", "номер детали", "деталь", "код", "артикул", "каталожный номер",
]

PART_NO_ANTI = [
    "cpac", "fnd", "gpc", "поставщик", "supplier", "vehicle", "материал", "описание",
    "серийный", "serial",
]

NAME = [
    "零件名称", "零部件名称", "物料名称", "物料描述", "描述", "名称", "物料名称/描述", "材料名称",
    "零件名称(中文）", "零件名称(中文)", "零件名称（中文）",
    "零件名称(英文）", "零件名称(英文)", "零件名称（英文）",
    "物料描述（中文）", "物料描述(中文）", "物料描述（英文）", "物料描述(英文）",
    "part name", "description", "material description", "item description", "component name",
    "part name(cn)", "part name(en)", "part name(cn）", "part name(en）",
    "name(cn)", "name(en)", "name（cn）", "name（en）",
    "наименование", "наименование детали", "название", "описание", "описание детали",
]

NAME_ANTI = [
    "工厂", "厂家", "供应商", "制造商", "生产商", "模块",
    "factory", "manufacturer", "supplier", "module",
    "завод", "производитель", "поставщик",
]

QTY = [
    "用量", "数量", "单车用量", "每车用量", "数量/用量", "标配数量", "用量/数量", "单位用量",
    "qty", "quantity", "usage", "qty per",
    "количество", "кол-во", "расход", "норма",
]

QTY_ANTI = ["工具数量", "扭矩数量", "工具", "模具数量", "工装数量"]

META = [
    "序号", "行号", "修订", "版本", "层级", "等级", "标识", "发运", "采购", "度量单位", "uom", "gpc",
    "fnd", "物料状态", "来源车间", "使用工厂", "目标车间", "供应商", "供应商代码", "供应商名称",
    "生产工厂", "供货工厂", "制造工厂", "装配工厂", "安装工厂", "mwo", "mwo单号", "生效日期",
    "失效日期", "整车物料号", "变更单号", "eop", "eos", "零件成熟度", "物料组", "物料组描述",
    "cpac编码", "cpac描述", "品牌", "车系", "卸货工厂", "备注", "说明", "附注", "注", "分类", "类别",
    "车型", "状态号", "模块状态", "供货状态", "PBOM供货", "平台属性", "设计层次", "装配层次",
    "工位范围", "工位", "工序", "零件质量", "IA编码", "货源", "货源描述", "结构货源", "单车用量",
    "组件数量", "发动机附件",
    "扭矩", "力矩", "动态扭矩", "残余扭矩", "扭矩角度", "扭矩关重", "扭矩说明", "扭矩监控",
    "图示编号", "图纸编号", "图纸号", "示意图编号",
    "serial no", "serial no.", "serial", "seq", "sequence", "revision", "rev", "version", "ver",
    "level", "ship", "purchase", "uom", "unit", "gpc code", "fnd code", "make/buy", "source shop",
    "using plant", "target shop", "supplier", "supplier code", "supplier name", "mwo",
    "effective date", "expire date", "vehicle material", "vehicle model", "remark", "note",
    "notes", "comment", "category", "classification", "type", "logo", "identification", "id",
    "torque", "nm", "n·m", "moment",
    "примечание", "комментарий", "завод", "поставщик", "дата", "статус", "система", "узел",
    "подразделение", "расход на один автомобиль", "количество компонентов",
]

STRICT_META = [
    "序号", "修订", "版本", "度量单位", "uom", "gpc", "fnd", "零件成熟度", "make/buy", "cpac编码",
    "serial no", "serial", "revision", "level", "变更记录", "文件编号",
]

GRAPHIC_NUMBER = [
    "图示编号", "图号", "图纸编号", "图纸号", "示意图编号", "工序号", "工位号", "工位编号",
    "graphic number", "drawing number", "drawing no", "drawing no.", "operation number",
    "operation no", "operation no.", "station number", "station no",
    "номер схемы", "номер операции", "номер чертежа", "код операции", "позиция схемы",
]

# --- sheet names -------------------------------------------------------------
SERVICE_SHEET = [
    "封面", "目录", "记录表", "空表", "范本", "填写说明", "содержание", "обложка", "变更记录", "变更",
    "汇总", "原稿", "分装", "分总成", "申请", "路线", "ebom", "mbom", "bom原稿", "bom汇总", "bom变更",
    "物料号汇总",
]

BOM_SHEET_NAME = [
    "bom", "总装", "涂装", "焊装", "零部件", "附件", "сборка", "комплект", "список деталей",
]

POOLED_SHEET = ["总装bom", "涂装bom", "焊装bom"]
POOLED_CONFIG = "MULTI_SHEET_COMBINED"

# --- file classification -----------------------------------------------------
SERVICE_FILE = [
    "封面", "目录", "记录表", "空表", "填写范本", "填写说明", "工艺现场工时汇总清单", "工时汇总", "对比",
    "обложка", "содержание", "cover", "toc", "template",
]

OPERATIONAL_FILE = ["作业指导书", "作业要领书", "操作指导", "工艺卡", "工序卡"]

# --- header words of the automatic fallbacks ---------------------------------
AUTO_BOM = {
    "part_no": ["零件号", "part_no", "part number", "物料号", "料号"],
    "qty": ["数量", "qty", "quantity", "用量", "需求量", "单车用量"],
    "name_cn": ["零件名称", "物料名称", "名称"],
    "name_en": ["英文", "english", "name_en"],
}

AUTO_CARD = {
    "part_no": ["零件件号", "零件号", "part_no", "part number", "物料号", "料号", "编号", "part no"],
    "qty": ["数量", "qty", "quantity", "用量", "需求量"],
    "name": ["名称", "name", "零件名称", "物料名称", "描述"],
}

# --- card sheets -------------------------------------------------------------
STACKED_HEADER = ["零部件代号", "零件号", "part_no", "序号", "料号", "物料号"]
FALSE_PART_PREFIX = ["更改", "文件", "变更", "修订", "版本"]
FALSE_PART_WORD = "件号"
OPERATION_SKIP = [
    "作业指导书", "文件编号", "工具/夹具", "版本", "发行时间", "关键点", "车间", "序号", "变更记录",
    "物料清单", "说明性符号", "编制", "校对", "审核", "批准", "无",
]
OPERATION_ELEMENT = "作业要素"
MAKER_MARK = "鑫源汽车"
INSPECTION_HEADER = "检验项目"
INSPECTION_TITLE = ["检验", "作业指导", "指导书"]

# --- value words -------------------------------------------------------------
GARBAGE = ["n/a", "na", "none", "无", "null", "-", "--", "---", "/"]
VALUE_HEADER_WORD = ["零件", "物料", "部件", "part", "компонент"]
CN_HINT = ["中文", "cn", "(chinese)", "chinese"]
EN_MARK = ["英文", "english", "en)", "en）", "(en", "（en", "inglés"]
DESCRIPTION_STEM = ["descript", "наимен", "описан"]

# --- workbook package --------------------------------------------------------
REQUIRED_ENTRY = [
    "[Content_Types].xml", "xl/workbook.xml", "xl/_rels/workbook.xml.rels", "_rels/.rels",
]

# --- report labels -----------------------------------------------------------
DISCREPANCY_LABEL = {
    "only_in_bom": "Есть в BOM, нет в операционных картах",
    "only_in_cards": "Есть в операционных картах, нет в BOM",
    "qty_mismatch": "Разное количество",
    "fuzzy_match": "Разный формат номера",
}
