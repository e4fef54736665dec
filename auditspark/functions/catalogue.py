"""The catalogue of voucher types."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The voucher types of each category.
TYPES_OF = {
    "发票类": (
        "增值税专用发票", "增值税普通发票", "增值税电子普通发票", "增值税电子专用发票", "全电发票", "定额发票", "通用机打发票", "红字发票", "机动车销售发票", "二手车销售发票", "农产品收购发票", "服务业发票", "建筑安装业发票",
        "交通运输业发票", "餐饮发票", "住宿发票", "物业费发票", "水电费发票", "通信费发票", "保险费发票",
    ),
    "差旅票据类": (
        "航空运输电子客票", "铁路车票", "出租车发票", "过路费发票", "停车费发票", "航空运输货运单", "船票", "汽车客运票",
    ),
    "银行/资金类": (
        "银行回单", "银行对账单", "银行进账单", "电汇凭证", "银行承兑汇票", "商业承兑汇票", "转账支票", "现金支票", "利息单", "手续费回单", "信用证", "保函", "贴现凭证", "贷款借据", "还款凭证", "结汇水单", "国际汇款申请书",
        "现金缴款单",
    ),
    "函证/审计类": (
        "银行询证函", "企业询证函", "应收账款询证函", "应付账款询证函", "存货询证函", "对账函", "催款函", "审计报告", "验资报告", "审计工作底稿", "审计业务约定书", "管理层声明书", "专项审计报告", "内部控制审计报告",
    ),
    "税务类": (
        "完税凭证", "海关进口增值税缴款书", "非税收入票据", "税收缴款书", "纳税申报表", "个人所得税纳税记录", "增值税发票汇总表", "出口退税申报表", "税务登记证", "税务事项通知书", "企业所得税汇算清缴", "印花税票", "房产税申报表",
        "车辆购置税发票",
    ),
    "企业内部管理类": (
        "费用报销单", "差旅费报销单", "付款申请单", "借款单", "入库单", "出库单", "调拨单", "盘点表", "现金盘点表", "银行存款余额调节表", "内部转账单", "出差申请单", "采购申请单", "验收单", "送货单", "比价单",
    ),
    "薪酬/人事/合同类": (
        "工资单", "劳务费发放表", "社保缴费凭证", "公积金缴存凭证", "考勤表", "年终奖金表", "加班工资表", "劳动合同", "劳务合同", "福利费发放表",
    ),
    "账簿/分录/报表类": (
        "记账凭证", "原始凭证", "收款凭证", "付款凭证", "转账凭证", "总账", "明细账", "日记账", "资产负债表", "利润表", "现金流量表", "所有者权益变动表",
    ),
    "固定资产/成本类": (
        "固定资产卡片", "固定资产报废单", "折旧计算表", "成本计算单", "材料领用单", "固定资产调拨单", "固定资产增加单", "无形资产台账",
    ),
    "收据/合同/资质类": (
        "收据", "捐赠收据", "会费收据", "购销合同", "租赁合同", "营业执照", "开户许可证", "组织机构代码证", "医疗收费票据", "诉讼费票据",
    ),
}
OTHER = "其他"


def type_catalogue(spark: SparkSession) -> DataFrame:
    """i, type, category: one row for each voucher type, numbered in order."""
    rows = [(t, c) for c, types in TYPES_OF.items() for t in types]
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, type string, category string")


def category_of_type(kind: Column) -> Column:
    """The category of a type; 其他 for an unknown one."""
    pairs = [F.lit(x) for c, types in TYPES_OF.items() for t in types for x in (t, c)]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), kind), F.lit(OTHER))
