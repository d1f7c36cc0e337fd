"""Rule goldens: lines put together at run time, and the rules that hit them."""


def A(n: int) -> str:
    return ("Ab3dEf7h" * (n // 8 + 1))[:n]


def rule_lines() -> list[tuple[str, list[int]]]:
    pem = "-----BEGIN "
    return [
        (f'<add key="dbPassword" value="{A(8)}" />', [0]),
        (f'<add key="passwdPMC" value="{A(8)}" />', [0, 1]),
        (f'<add key="usuarioPMC" value="{A(5)}" />', [2]),
        (f'<add key="sshostKey" value="{A(16)}" />', [3]),
        ("APP_PUBLIC_KEY=" + A(20), [4]),
        ("APP_PRIVATE_KEY=" + A(20), [5]),
        ("db_password=" + A(10), [6]),
        ("a_password=" + A(8) + " b_password=" + A(9), [6, 6]),
        ("db_password=" + "abc", []),
        ("aws_access_key_id=" + "AKIA" + "Q7" * 8, [7]),
        ("aws_secret_access_key=" + A(40), [8, 23]),
        ("github_token=" + "gh" + "p_" + A(36), [9, 12]),
        ("github_oauth_token=" + "gh" + "o_" + A(36), [10, 12]),
        ("my_api_key=" + A(24), [11]),
        ("apiKey: " + A(24), []),
        ('"my_apiKey": "' + A(24) + '"', []),
        ("token=" + A(24), [12]),
        ("jwt_token=" + "ey" + "J" + A(10) + "." + A(10) + "." + A(10), [12, 13]),
        (pem + "RSA PRIVATE KEY-----", [14]),
        (pem + "PRIVATE KEY-----", [14, 15]),
        (pem + "EC PRIVATE KEY-----", []),
        (pem + "OPENSSH PRIVATE KEY-----", [15]),
        (pem + "PUBLIC KEY-----", [16]),
        ("google_api_key=" + "AI" + "za" + A(35), [11, 17]),
        ("google_client_secret=" + A(24), [18]),
        ("stripe_secret_key=" + "sk_" + "live_" + A(24), [19, 23]),
        ("stripe_api_key=" + "sk_" + "test_" + A(24), [11, 19]),
        ("stripe_publishable_key=" + "pk_" + "live_" + A(24), [20]),
        ("slack_token=" + "xo" + "xb-" + A(12), [21]),
        ("discord_bot_token=" + A(59), [12, 22]),
        ("secret_key=" + A(16), [23]),
        ("database_uri=" + "postgres://u:p@h/db", [24]),
        ("credential=" + A(16), [25]),
        ("azure_storage_key=" + A(86) + "==", [26]),
        ("twilio_auth_token=" + A(32), [12, 27]),
        ("twilio_api_key=" + A(32), [11, 27]),
        ("mailgun_api_key=" + "key-" + A(32), [11, 28]),
        ("sendgrid_api_key=" + "SG." + A(22) + "." + A(43), [29]),
        ("example_pattern=" + A(10), [30]),
        ('db_password = os.getenv("DB_PASSWORD")', [6]),
        ("DB_PASSWORD=${DB_PASSWORD}", [6]),
        ("my_api_key = process.env.SERVICE_API_KEY_VALUE", []),
    ]
