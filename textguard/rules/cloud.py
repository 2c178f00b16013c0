"""Cloud-identifier rules: AWS, GCP, Azure, Kubernetes, registries, internal hosts."""

from textguard.rules.base import Rule

# Patterns, descriptions, severities, labels.
PATTERNS = [
    ("CLD-01", r"arn:aws:[a-z0-9\-]+:[a-z0-9\-]*:\d{0,12}:[^\s\"',]+", "AWS ARN", "high", "AWS_ARN",
     "arn:aws", "role arn:aws:s3:::demo-bucket here", "arn:aws only"),
    ("CLD-02", r"\bi-[0-9a-f]{8,17}\b", "AWS EC2 Instance ID", "medium", "AWS_EC2_INSTANCE", "re:-[0-9a-f]{8} & i-", "node i-0abcdef1234567890 up", "node i-0abc up"),
    ("CLD-03", r"\bami-[0-9a-f]{8,17}\b", "AWS AMI ID", "low", "AWS_AMI", "re:-[0-9a-f]{8} & ami-", "image ami-0abcdef12 up", "image ami-0abc up"),
    ("CLD-04", r"\bsg-[0-9a-f]{8,17}\b", "AWS Security Group ID", "medium", "AWS_SG", "re:-[0-9a-f]{8} & sg-", "group sg-0abcdef12 up", "group sg-0abc up"),
    ("CLD-05", r"\bvpc-[0-9a-f]{8,17}\b", "AWS VPC ID", "medium", "AWS_VPC", "re:-[0-9a-f]{8} & vpc-", "net vpc-0abcdef12 up", "net vpc-0abc up"),
    ("CLD-06", r"\bsubnet-[0-9a-f]{8,17}\b", "AWS Subnet ID", "low", "AWS_SUBNET", "re:-[0-9a-f]{8} & subnet-", "net subnet-0abcdef12 up", "net subnet-0abc up"),
    ("CLD-07", r"\bvol-[0-9a-f]{8,17}\b", "AWS EBS Volume ID", "low", "AWS_EBS_VOL", "re:-[0-9a-f]{8} & vol-", "disk vol-0abcdef12 up", "disk vol-0abc up"),
    ("CLD-08", r"\bsnap-[0-9a-f]{8,17}\b", "AWS Snapshot ID", "low", "AWS_SNAPSHOT", "re:-[0-9a-f]{8} & snap-", "copy snap-0abcdef12 up", "copy snap-0abc up"),
    ("CLD-09", r"\brtb-[0-9a-f]{8,17}\b", "AWS Route Table ID", "low", "AWS_RTB", "re:-[0-9a-f]{8} & rtb-", "route rtb-0abcdef12 up", "route rtb-0abc up"),
    ("CLD-10", r"\bigw-[0-9a-f]{8,17}\b", "AWS Internet Gateway ID", "low", "AWS_IGW", "re:-[0-9a-f]{8} & igw-", "gate igw-0abcdef12 up", "gate igw-0abc up"),
    ("CLD-11", r"\beks:[a-z0-9\-]+:[a-z0-9\-]+:cluster/[a-zA-Z0-9\-]+", "AWS EKS Cluster ARN", "high", "AWS_EKS", "/ & cluster/", "at eks:eu-west-1:111:cluster/demo live", "at eks:demo live"),
    ("CLD-12", r"\b[a-z0-9\-]+\.execute-api\.[a-z0-9\-]+\.amazonaws\.com\b", "AWS API Gateway URL", "medium", "AWS_APIGW", r"re:\.[a-z] & amazonaws", "abc1.execute-api.eu-west-1.amazonaws.com", "execute-api docs"),
    ("CLD-13", r"\b[a-z0-9\-]+\.s3(?:\.[a-z0-9\-]+)?\.amazonaws\.com\b", "AWS S3 Bucket URL", "medium", "AWS_S3_URL", r"re:\.[a-z] & amazonaws", "files.s3.amazonaws.com", "s3 docs"),
    ("CLD-14", r"\b[a-z0-9\-]+\.rds\.[a-z0-9\-]+\.amazonaws\.com\b", "AWS RDS Endpoint", "high", "AWS_RDS_ENDPOINT", r"re:\.[a-z] & amazonaws", "main.rds.eu-west-1.amazonaws.com", "rds docs"),
    ("CLD-15", r"\b[a-z0-9\-]+\.cache\.[a-z0-9\-]+\.amazonaws\.com\b", "AWS ElastiCache Endpoint", "high", "AWS_ELASTICACHE", r"re:\.[a-z] & amazonaws", "main.cache.eu-west-1.amazonaws.com", "cache docs"),
    ("CLD-16", r"\b\d{12}\.dkr\.ecr\.[a-z0-9\-]+\.amazonaws\.com\b", "AWS ECR Registry URL", "high", "AWS_ECR", r"re:\.[a-z] & amazonaws", "pull 111122223333.dkr.ecr.eu-west-1.amazonaws.com", "ecr docs"),
    ("CLD-17", r"console\.aws\.amazon\.com/[a-z0-9\-/]+\?[^\s\"']+", "AWS Console URL with params", "medium", "AWS_CONSOLE_URL", r"re:\.[a-z] & console.aws", "console.aws.amazon.com/ec2/v2?region=eu", "console.aws.amazon.com"),
    ("CLD-18", r"projects/[a-z][a-z0-9\-]{4,28}[a-z0-9]/(?:zones|regions|global)/[^\s\"',]+", "GCP Resource Path", "high", "GCP_RESOURCE", "/ & projects/", "projects/demo-project/zones/europe-west1-b", "projects/demo"),
    ("CLD-19", r"\b[a-z0-9\-]+\.googleapis\.com\b", "GCP API Endpoint", "medium", "GCP_API_ENDPOINT", r"re:\.[a-z] & googleapis", "call pubsub.googleapis.com", "googleapis docs"),
    ("CLD-20", r"storage\.googleapis\.com/[a-z0-9\-_\.]+", "GCP Cloud Storage URL", "medium", "GCP_GCS_URL", r"re:\.[a-z] & googleapis", "storage.googleapis.com/demo_files", "cloud storage"),
    ("CLD-21", r"\b[a-z0-9\-]+\.cloudfunctions\.net\b", "GCP Cloud Functions URL", "medium", "GCP_CF_URL", r"re:\.[a-z] & cloudfunctions", "demo-fn.cloudfunctions.net", "cloudfunctions docs"),
    ("CLD-22", r"\b[a-z0-9\-]+\.run\.app\b", "GCP Cloud Run URL", "medium", "GCP_RUN_URL", r"re:\.[a-z] & .run.app", "demo-svc.run.app", "run app"),
    ("CLD-23", r"gcr\.io/[a-z0-9\-]+/[a-zA-Z0-9\-_/]+", "GCP Container Registry", "medium", "GCP_GCR", r"re:\.[a-z] & gcr.io", "gcr.io/demo/api_v1", "gcr.io"),
    ("CLD-24", r"pkg\.dev/[a-z0-9\-]+/[a-zA-Z0-9\-_/]+", "GCP Artifact Registry", "medium", "GCP_AR", r"re:\.[a-z] & pkg.dev", "pkg.dev/demo/api_v1", "pkg.dev"),
    ("CLD-25", r"/subscriptions/[0-9a-f\-]{36}/resourceGroups/[^\s\"',/]+", "Azure Resource Group Path", "high", "AZURE_RG", "/ & subscriptions/", "/subscriptions/12345678-1234-1234-1234-123456789012/resourceGroups/demo", "/subscriptions/1/resourceGroups/demo"),
    ("CLD-26", r"\b[a-z0-9\-]+\.blob\.core\.windows\.net\b", "Azure Blob Storage URL", "medium", "AZURE_BLOB", r"re:\.[a-z] & windows.net", "files.blob.core.windows.net", "blob core"),
    ("CLD-27", r"\b[a-z0-9\-]+\.database\.windows\.net\b", "Azure SQL Server Endpoint", "high", "AZURE_SQL", r"re:\.[a-z] & windows.net", "main.database.windows.net", "windows.net"),
    ("CLD-28", r"\b[a-z0-9\-]+\.azurewebsites\.net\b", "Azure App Service URL", "medium", "AZURE_WEBAPP", r"re:\.[a-z] & azure", "demo.azurewebsites.net", "azurewebsites"),
    ("CLD-29", r"\b[a-z0-9\-]+\.azure-api\.net\b", "Azure API Management URL", "medium", "AZURE_APIM", r"re:\.[a-z] & azure", "demo.azure-api.net", "azure api"),
    ("CLD-30", r"\b[a-z0-9\-]+\.azurecr\.io\b", "Azure Container Registry", "medium", "AZURE_ACR", r"re:\.[a-z] & azure", "demo.azurecr.io", "azure cr"),
    ("CLD-31", r"\b[a-z0-9\-]+\.servicebus\.windows\.net\b", "Azure Service Bus", "medium", "AZURE_SB", r"re:\.[a-z] & windows.net", "demo.servicebus.windows.net", "service bus"),
    ("CLD-32", r"\b[a-z0-9\-]+\.vault\.azure\.net\b", "Azure Key Vault URL", "high", "AZURE_KEYVAULT", r"re:\.[a-z] & azure", "demo.vault.azure.net", "key vault"),
    ("CLD-33", r"https?://[a-z0-9\-\.]+:\d{4,5}(?=/api/v[12])", "Kubernetes API Server URL", "high", "K8S_API_SERVER", ":// & /api/v", "https://kube.example.org:6443/api/v1/pods", "https://kube.example.org:6443/api/v3"),
    ("CLD-34", r"\bkube(?:config|ctl)\b.*(?:--server|--token|--certificate)", "Kubectl with credentials", "critical", "KUBECTL_CRED", "-- & kube", "kubectl get pods --token abc", "kubectl get pods"),
    ("CLD-35", r"cluster\.local(?:/[^\s\"']+)?", "Kubernetes cluster.local reference", "low", "K8S_CLUSTER_LOCAL", r"re:\.[a-z] & cluster.local", "svc.cluster.local/health", "cluster local"),
    ("CLD-36", r"[a-z0-9\-]+\.azurecr\.io/[a-zA-Z0-9\-_/]+:[a-zA-Z0-9\-_\.]+", "Azure ACR Image", "medium", "ACR_IMAGE", r"re:\.[a-z] & azure", "demo.azurecr.io/api:v1.2", "demo.azurecr io"),
    ("CLD-37", r"\d{12}\.dkr\.ecr\.[a-z0-9\-]+\.amazonaws\.com/[a-zA-Z0-9\-_/]+", "ECR Image Reference", "high", "ECR_IMAGE", r"re:\.[a-z] & amazonaws", "111122223333.dkr.ecr.eu-west-1.amazonaws.com/api", "dkr ecr"),
    ("CLD-38", r"\b(?:prod|staging|stg|dev|internal|corp|infra)[\-\.][\w\-\.]+\.(?:internal|local|corp|lan|intranet)\b", "Internal hostname", "high", "INTERNAL_HOSTNAME",
     r"re:\.[a-z] & .internal or .local or .corp or .lan or .intranet", "prod-api-01.internal", "prod-api-01.example"),
    ("CLD-39", r"\b(?:db|database|mysql|postgres|redis|mongo|elastic|kafka|rabbit)[\-\.][\w\-]+(?:\.internal|\.local|\.corp)?\b", "Internal database hostname", "high", "DB_HOSTNAME",
     r"re:[-.][^\s] & db or database or mysql or postgres or redis or mongo or elastic or kafka or rabbit", "use redis-cache01 here", "use redis here"),
    ("CLD-40", r"\b(?:jenkins|gitlab|github|bitbucket|jira|confluence|sonar|nexus|artifactory)[\-\.][\w\-]+\.(?:internal|local|corp)\b", "Internal tool hostname", "medium", "INTERNAL_TOOL",
     r"re:\.[a-z] & .internal or .local or .corp & jenkins or gitlab or github or bitbucket or jira or confluence or sonar or nexus or artifactory", "jira.team.corp", "jira team"),
    ("CLD-41", r"https://console\.cloud\.google\.com/[^\s\"']*project=[a-z0-9\-]+", "GCP Console URL with project", "medium", "GCP_CONSOLE_URL", ":// & console.cloud", "https://console.cloud.google.com/run?project=demo", "https://console.cloud.google.com/run"),
    ("CLD-42", r"https://portal\.azure\.com/[^\s\"']*subscriptions/[0-9a-f\-]{36}", "Azure Portal URL with subscription", "medium", "AZURE_PORTAL_URL", ":// & portal.azure", "https://portal.azure.com/#/subscriptions/12345678-1234-1234-1234-123456789012", "https://portal.azure.com/home"),
    ("CLD-43", r'"sensitive":\s*true.*"value":\s*"[^"]{8,}"', "Terraform sensitive output value", "critical", "TF_SENSITIVE", '"sensitive"', '{"sensitive": true, "value": "demo-value-1"}', '{"sensitive": true}'),
    ("CLD-44", r"terraform\.tfstate", "Terraform state file reference", "high", "TF_STATE_FILE", r"re:\.[a-z] & tfstate", "see terraform.tfstate there", "see terraform state"),
]


def rules() -> list[Rule]:
    return [
        Rule(rid, "cloud", regex, desc, severity, 0.90, "pii_input", flags="im",
             label=label, shape="wrap60", needs=needs, hit=hit, miss=miss)
        for rid, regex, desc, severity, label, needs, hit, miss in PATTERNS
    ]


def extra_rules(patterns: list[tuple[str, str]]) -> list[Rule]:
    """Caller-supplied (regex, label) pairs as additional cloud rules."""
    return [
        Rule(f"CLD-X{i:02d}", "cloud", regex, f"Company cloud resource: {label}", "high", 0.90,
             "pii_input", flags="i", label=label, shape="wrap60", origin="caller")
        for i, (regex, label) in enumerate(patterns, 1)
    ]
