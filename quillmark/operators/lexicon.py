"""Default tables of the question enhancer; all are parameters."""

# Abbreviations and names with what they expand to.
SYNONYMS: dict[str, list[str]] = {
    "mi": ["myocardial infarction", "heart attack"],
    "ami": ["acute myocardial infarction"],
    "chf": ["congestive heart failure", "heart failure"],
    "hf": ["heart failure"],
    "af": ["atrial fibrillation"],
    "afib": ["atrial fibrillation"],
    "vte": ["venous thromboembolism", "deep vein thrombosis", "pulmonary embolism"],
    "dvt": ["deep vein thrombosis"],
    "pe": ["pulmonary embolism"],
    "htn": ["hypertension", "high blood pressure"],
    "cad": ["coronary artery disease", "coronary heart disease"],
    "cvd": ["cardiovascular disease"],
    "stroke": ["cerebrovascular accident", "cva"],
    "心梗": ["心肌梗死", "心肌梗塞", "myocardial infarction"],
    "心衰": ["心力衰竭", "心功能衰竭", "heart failure"],
    "房颤": ["心房颤动", "atrial fibrillation"],
    "中风": ["脑卒中", "脑梗", "脑出血", "stroke"],
    "冠心病": ["冠状动脉粥样硬化性心脏病", "冠状动脉性心脏病", "coronary heart disease"],
    "高血压": ["高血压病", "血压高", "hypertension"],
    "dm": ["diabetes mellitus", "diabetes"],
    "t2dm": ["type 2 diabetes mellitus", "type 2 diabetes", "non-insulin dependent diabetes"],
    "t1dm": ["type 1 diabetes mellitus", "type 1 diabetes", "insulin dependent diabetes"],
    "iddm": ["type 1 diabetes", "insulin dependent diabetes"],
    "niddm": ["type 2 diabetes", "non-insulin dependent diabetes"],
    "糖尿病": ["糖尿病 mellitus", "消渴症", "diabetes"],
    "二型糖尿病": ["2型糖尿病", "2型糖尿病 mellitus", "type 2 diabetes"],
    "一型糖尿病": ["1型糖尿病", "1型糖尿病 mellitus", "type 1 diabetes"],
    "甲亢": ["甲状腺功能亢进症", "hyperthyroidism"],
    "甲减": ["甲状腺功能减退症", "hypothyroidism"],
    "ca": ["cancer", "carcinoma"],
    "nsclc": ["non-small cell lung cancer", "non-small cell lung carcinoma"],
    "sclc": ["small cell lung cancer"],
    "hcc": ["hepatocellular carcinoma"],
    "crc": ["colorectal cancer"],
    "aml": ["acute myeloid leukemia"],
    "cml": ["chronic myeloid leukemia"],
    "all": ["acute lymphoblastic leukemia"],
    "cll": ["chronic lymphocytic leukemia"],
    "nhl": ["non-hodgkin lymphoma"],
    "hl": ["hodgkin lymphoma"],
    "肺癌": ["肺肿瘤", "lung cancer", "nsclc"],
    "乳腺癌": ["乳腺肿瘤", "breast cancer"],
    "肝癌": ["肝肿瘤", "liver cancer", "hcc"],
    "胃癌": ["胃肿瘤", "gastric cancer"],
    "肠癌": ["结直肠癌", "colorectal cancer", "crc"],
    "白血病": ["血癌", "leukemia"],
    "淋巴瘤": ["淋巴癌", "lymphoma"],
    "ad": ["alzheimer disease", "alzheimer's disease"],
    "pd": ["parkinson disease", "parkinson's disease"],
    "als": ["amyotrophic lateral sclerosis"],
    "ms": ["multiple sclerosis"],
    "ckd": ["chronic kidney disease"],
    "esrd": ["end stage renal disease"],
    "ckd-epi": [],
    "tbi": ["traumatic brain injury"],
    "mdd": ["major depressive disorder", "depression"],
    "阿尔茨海默": ["阿尔茨海默病", "老年痴呆", "alzheimer disease"],
    "帕金森": ["帕金森病", "震颤麻痹", "parkinson disease"],
    "癫痫": ["羊癫疯", "epilepsy"],
    "抑郁症": ["抑郁障碍", "depression"],
    "脑梗": ["脑梗塞", "脑梗死", "cerebral infarction"],
    "脑出血": ["脑溢血", "cerebral hemorrhage"],
    "hiv": ["human immunodeficiency virus"],
    "aids": ["acquired immune deficiency syndrome", "acquired immunodeficiency syndrome"],
    "tb": ["tuberculosis"],
    "mtb": ["mycobacterium tuberculosis"],
    "uti": ["urinary tract infection"],
    "rsv": ["respiratory syncytial virus"],
    "hpv": ["human papillomavirus"],
    "hbv": ["hepatitis b virus"],
    "hcv": ["hepatitis c virus"],
    "covid": ["covid-19", "sars-cov-2", "coronavirus disease 2019"],
    "sars": ["severe acute respiratory syndrome"],
    "mrsa": ["methicillin-resistant staphylococcus aureus"],
    "艾滋": ["艾滋病", "获得性免疫缺陷综合征", "aids"],
    "乙肝": ["乙型肝炎", "hbv"],
    "丙肝": ["丙型肝炎", "hcv"],
    "结核": ["肺结核", "结核病", "tuberculosis"],
    "新冠": ["新冠肺炎", "covid-19", "新型冠状病毒肺炎"],
    "copd": ["chronic obstructive pulmonary disease"],
    "ards": ["acute respiratory distress syndrome"],
    "osa": ["obstructive sleep apnea"],
    "慢阻肺": ["慢性阻塞性肺疾病", "copd"],
    "gerd": ["gastroesophageal reflux disease"],
    "ibd": ["inflammatory bowel disease"],
    "uc": ["ulcerative colitis"],
    "ibs": ["irritable bowel syndrome"],
    "nafld": ["non-alcoholic fatty liver disease"],
    "nash": ["non-alcoholic steatohepatitis"],
    "胃食管反流": ["反流性食管炎", "gerd"],
    "脂肪肝": ["非酒精性脂肪肝", "nafld"],
    "肝硬化": ["肝纤维化", "cirrhosis"],
    "ra": ["rheumatoid arthritis"],
    "sle": ["systemic lupus erythematosus", "lupus"],
    "oa": ["osteoarthritis"],
    "类风湿": ["类风湿关节炎", "ra"],
    "红斑狼疮": ["系统性红斑狼疮", "sle"],
    "骨关节炎": ["退行性关节炎", "osteoarthritis"],
    "asa": ["aspirin", "acetylsalicylic acid"],
    "apap": ["acetaminophen", "paracetamol"],
    "nsaid": ["non-steroidal anti-inflammatory drug", "nonsteroidal anti-inflammatory drug"],
    "nsaids": ["non-steroidal anti-inflammatory drugs"],
    "ssri": ["selective serotonin reuptake inhibitor"],
    "ssris": ["selective serotonin reuptake inhibitors"],
    "snri": ["serotonin norepinephrine reuptake inhibitor"],
    "ppi": ["proton pump inhibitor"],
    "ppis": ["proton pump inhibitors"],
    "acei": ["angiotensin-converting enzyme inhibitor", "ace inhibitor"],
    "arb": ["angiotensin receptor blocker"],
    "statin": ["hmg-coa reductase inhibitor", "statin drug"],
    "阿司匹林": ["乙酰水杨酸", "aspirin"],
    "二甲双胍": ["格华止", "metformin"],
    "华法林": ["warfarin"],
    "胰岛素": ["insulin"],
    "他汀": ["他汀类药物", "statin"],
    "布洛芬": ["ibuprofen"],
    "对乙酰氨基酚": ["扑热息痛", "paracetamol", "acetaminophen"],
    "奥美拉唑": ["omeprazole"],
    "氯吡格雷": ["clopidogrel"],
    "恩格列净": ["empagliflozin"],
    "达格列净": ["dapagliflozin"],
    "利拉鲁肽": ["liraglutide"],
    "司美格鲁肽": ["semaglutide"],
    "阿莫西林": ["amoxicillin"],
    "头孢": ["头孢菌素", "cephalosporin"],
    "青霉素": ["penicillin"],
    "红霉素": ["erythromycin"],
    "强的松": ["prednisone"],
    "泼尼松": ["prednisone"],
    "地塞米松": ["dexamethasone"],
    "吗啡": ["morphine"],
    "芬太尼": ["fentanyl"],
    "利福平": ["rifampicin"],
    "异烟肼": ["isoniazid"],
    "奥希替尼": ["osimertinib"],
    "阿扎胞苷": ["azacitidine"],
    "来那度胺": ["lenalidomide"],
    "硼替佐米": ["bortezomib"],
    "伊布替尼": ["ibrutinib"],
    "纳武单抗": ["nivolumab"],
    "帕博利珠单抗": ["pembrolizumab"],
    "卡铂": ["carboplatin"],
    "顺铂": ["cisplatin"],
    "吉西他滨": ["gemcitabine"],
    "培美曲塞": ["pemetrexed"],
    "舒尼替尼": ["sunitinib"],
    "索拉菲尼": ["sorafenib"],
    "仑伐替尼": ["lenvatinib"],
    "艾乐明": ["baricitinib"],
    "托珠单抗": ["tocilizumab"],
    "阿达木单抗": ["adalimumab"],
    "英夫利西单抗": ["infliximab"],
    "戈利木单抗": ["golimumab"],
    "培塞利珠": ["certolizumab"],
    "sglt2": ["sodium-glucose cotransporter 2 inhibitor", "sglt2 inhibitor"],
    "glp-1": ["glucagon-like peptide 1 receptor agonist", "glp-1 receptor agonist"],
    "dpp-4": ["dipeptidyl peptidase 4 inhibitor", "dpp-4 inhibitor"],
    "西格列汀": ["sitagliptin"],
    "利格列汀": ["linagliptin"],
    "沙格列汀": ["saxagliptin"],
    "维格列汀": ["vildagliptin"],
    "卡格列净": ["canagliflozin"],
    "艾托格列净": ["ertugliflozin"],
    "tnf": ["tumor necrosis factor", "tnf-alpha"],
    "vegf": ["vascular endothelial growth factor"],
    "egfr": ["epidermal growth factor receptor"],
    "her2": ["human epidermal growth factor receptor 2", "erbb2"],
    "pd-1": ["programmed cell death protein 1", "pdcd1"],
    "pd-l1": ["programmed death-ligand 1", "cd274"],
    "ctla-4": ["cytotoxic t-lymphocyte-associated protein 4"],
    "p53": ["tumor protein p53", "tp53"],
    "il-6": ["interleukin 6", "interleukin-6"],
    "egfr基因": ["表皮生长因子受体", "egfr"],
    "her2阳性": ["her2阳性乳腺癌", "erbb2 positive"],
}

# Mentions by type (parts of patterns).
MENTIONS: dict[str, list[str]] = {
    "drug": [
        "aspirin", "metformin", "atorvastatin", "warfarin", "insulin", "glipizide", "lisinopril", "amlodipine", "metoprolol", "losartan", "hydrochlorothiazide", "omeprazole", "pantoprazole", "simvastatin",
        "rosuvastatin", "clopidogrel", "paracetamol", "acetaminophen", "ibuprofen", "naproxen", "celecoxib", "amoxicillin", "azithromycin", "ciprofloxacin", "doxycycline", "prednisone", "methylprednisolone",
        "dexamethasone", "doxorubicin", "cisplatin", "paclitaxel", "tamoxifen", "imatinib", "trastuzumab", "bevacizumab", "rituximab", "remdesivir", "molnupiravir", "paxlovid", "nirmatrelvir",
        "semaglutide", "liraglutide", "empagliflozin", "dapagliflozin", "atenolol", "carvedilol", "digoxin", "amiodarone", "furosemide", "spironolactone", "albuterol", "salbutamol",
        "montelukast", "fluticasone", "budesonide", "sertraline", "fluoxetine", "citalopram", "escitalopram", "venlafaxine", "diazepam", "lorazepam", "midazolam", "morphine", "fentanyl",
    ],
    "disease": [
        r"diabetes(?:\s+mellitus)?", "hypertension", "asthma", "copd", "arthritis", "osteoporosis", r"alzheimer(?:'s)?(?:\s+disease)?", r"parkinson(?:'s)?(?:\s+disease)?", "epilepsy", "depression",
        "schizophrenia", "cancer", "leukemia", "lymphoma", "carcinoma", "cardiovascular disease", "coronary artery disease", "heart failure", "stroke", "myocardial infarction",
        "tuberculosis", "malaria", "pneumonia", "hepatitis", "cirrhosis", "nephritis", "pancreatitis", "inflammatory bowel disease", r"crohn(?:'s)?(?:\s+disease)?", "ulcerative colitis", "lupus", "psoriasis", "eczema",
    ],
    "gene_protein": [
        "BRCA1", "BRCA2", "TP53", "EGFR", "HER2", "ERBB2", "KRAS", "PIK3CA", "AKT1", "MAPK", "ERK", "JAK", "STAT", "VEGF", "TNF", "IL6", "CD4", "CD8", "CD20", "CD274", "CTLA4", "PDCD1", "ARNO", "ARF", "PLD", "GEF",
        "p53", "ras", "myc", "braf", "mek", "alk", "ros1", "met",
    ],
    "organism": [
        r"E\.?\s?coli", "HIV", "HSV", "EBV", "HPV", "HBV", "HCV", "SARS-CoV-2", "SARS-CoV", "SARS", "MERS-CoV", "Influenza", "Staphylococcus", "Streptococcus",
        "Plasmodium", "Mycobacterium", "Pseudomonas", "Candida", "Aspergillus", "Toxoplasma", "Treponema", "Helicobacter", "Salmonella", "HTLV-1", "HTLV",
    ],
    "anatomy": [
        "brain", "heart", "liver", "kidney", "lung", "pancreas", "intestine", "colon", "breast", "prostate", "skin", "bone", "cardiovascular", "cerebrovascular", "hepatic", "renal",
        "pulmonary", "gastric", "intestinal", "thymus", "spleen", "hippocampus", "cerebellum", "cortex",
    ],
}
#: A mention stands alone as a word.
ENTITIES = {kind: rf"\b(?:{'|'.join(parts)})\b" for kind, parts in MENTIONS.items()}

# Chinese mentions that are recognised (found by containment).
ENTITY_WORDS = {
    "disease_cn": ["糖尿病", "高血压病", "塞", "死", "病", "关节炎"],
    "drug_cn": ["阿司匹林", "二甲双胍", "华法林", "胰岛素", "他汀类药物", "菌素"],
    "anatomy_cn": ["脑", "心", "肝", "肾", "肺", "胰腺"],
}
