"""The taxonomy of business software that ideas are classified into.

All texts here are fixed values: results are only right if they are exactly these, in this order.
"""

from __future__ import annotations

from typing import NamedTuple


class Category(NamedTuple):
    category_id: str
    name: str
    subcategories: tuple[str, ...]
    keywords: tuple[str, ...]
    synonyms: tuple[str, ...] = ()
    buyer: str = "Department Head"
    use_cases: tuple[str, ...] = ()


# Categories in ranking order, with their leading buyer and first three use cases.
TAXONOMY = (
    Category(
        "crm_sales", "CRM & Sales",
        ("Sales CRM", "Lead Management", "Sales Engagement", "Revenue Operations", "CPQ (Configure, Price, Quote)"),
        ("crm", "sales", "pipeline", "lead", "leads", "prospect", "prospecting", "deal", "deals", "account executive", "bdr", "sdr", "revops", "cpq"),
        ("crm", "sales", "sales crm", "sales automation", "lead management", "customer relationship management", "revenue operations", "revops",
         "sales engagement", "cpq", "sales platform", "crm saas", "crm & sales"),
        "VP of Sales", ("Lead Management", "Sales Pipeline Tracking", "Contact Management"),
    ),
    Category(
        "hr_workforce", "HR & Workforce Management",
        ("HRIS / HRMS", "Payroll Software", "Recruitment / ATS", "Attendance & Time Tracking", "Performance Management", "Employee Engagement"),
        ("hr", "hrms", "hris", "payroll", "workforce", "recruitment", "ats", "applicant tracking", "hiring", "attendance", "employee", "staff",
         "talent", "benefits"),
        ("hr", "human resources", "hr software", "hrms", "hris", "payroll", "payroll software", "workforce management", "recruitment", "ats",
         "applicant tracking", "applicant tracking system", "talent acquisition", "attendance", "employee management", "hr & workforce management"),
        "Chief Human Resources Officer (CHRO)", ("Payroll Processing", "Employee Onboarding", "Applicant Tracking"),
    ),
    Category(
        "accounting_finance", "Accounting & Finance",
        ("Accounting Software", "Invoicing & Billing", "Expense Management", "FP&A / Financial Planning", "Tax & Compliance"),
        ("accounting", "finance", "invoice", "invoicing", "billing", "bookkeeping", "expense", "expenses", "tax", "gst", "cfo", "ledger", "audit",
         "treasury", "fpa"),
        ("accounting", "finance", "invoicing", "billing", "expense management", "bookkeeping", "fp&a", "financial planning", "tax software",
         "accounting & finance", "fintech b2b", "corporate finance"),
        "Chief Financial Officer (CFO)", ("Invoicing & Billing", "Corporate Expense Management", "Bookkeeping"),
    ),
    Category(
        "project_task_management", "Project & Task Management",
        ("Project Management", "Task Tracking", "Agile / Scrum Tools", "Resource Management", "Product Roadmap Planning"),
        ("project management", "task management", "tasks", "jira", "sprint", "kanban", "scrum", "milestones", "roadmap", "workflow",
         "work management"),
        ("project management", "task management", "project & task management", "project tracking", "agile", "kanban", "scrum", "work management"),
        "Head of Project Management", ("Sprint Planning", "Task Assignment", "Milestone Tracking"),
    ),
    Category(
        "marketing_automation", "Marketing & Marketing Automation",
        ("Email Marketing", "Marketing Automation", "SEO & Content Tools", "Social Media Management", "Ad Optimization & Attribution"),
        ("marketing", "email marketing", "campaign", "seo", "sem", "lead generation", "inbound", "outbound", "newsletter", "attribution",
         "growth marketing"),
        ("marketing", "marketing automation", "marketing & marketing automation", "email marketing", "seo", "social media management",
         "content marketing"),
        "Chief Marketing Officer (CMO)", ("Email Campaigns", "Marketing Automation", "Content Management"),
    ),
    Category(
        "customer_support_helpdesk", "Customer Support & Helpdesk",
        ("Helpdesk & Ticketing", "Live Chat & AI Support", "Customer Success Platform", "Knowledge Base SaaS", "Contact Center SaaS"),
        ("customer support", "helpdesk", "ticketing", "support ticket", "customer service", "live chat", "chatbot", "csat", "customer success", "cx"),
        ("customer support", "helpdesk", "customer support & helpdesk", "ticketing", "customer service", "customer success", "live chat"),
        "Head of Customer Support", ("Ticket Resolution", "Live Chat & Chatbots", "Knowledge Base Management"),
    ),
    Category(
        "erp_operations", "ERP & Business Operations",
        ("Cloud ERP", "Enterprise Operations", "Order Management", "Inventory Control"),
        ("erp", "enterprise resource planning", "netsuite", "sap", "business operations", "order management", "multi-entity"),
        ("erp", "enterprise resource planning", "erp & business operations", "business operations", "operations management"),
        "Chief Operating Officer (COO)", ("Enterprise Resource Planning", "Order Management", "Operational Workflow Control"),
    ),
    Category(
        "procurement_supply_chain", "Procurement & Supply Chain",
        ("Procurement SaaS", "Vendor Management", "Strategic Sourcing", "Supply Chain Management", "Warehouse Management"),
        ("procurement", "supply chain", "vendor management", "purchase order", "sourcing", "supplier", "rfp", "rfq", "warehouse"),
        ("procurement", "supply chain", "procurement & supply chain", "vendor management", "sourcing"),
        "Chief Procurement Officer (CPO)", ("Vendor Management", "Purchase Order Approval", "Strategic Sourcing"),
    ),
    Category(
        "cybersecurity", "Cybersecurity",
        ("Security Compliance SaaS", "Identity & Access Management (IAM)", "Cloud Security (CSPM)", "Threat Detection & SIEM", "Endpoint Security"),
        ("cybersecurity", "security", "soc 2", "iso 27001", "hipaa compliance", "iam", "vulnerability", "threat detection", "ciso", "cloud security",
         "infosec"),
        ("cybersecurity", "security", "information security", "infosec", "soc 2", "soc 2 compliance", "soc2 compliance", "cloud security",
         "compliance security"),
        "Chief Information Security Officer (CISO)",
        ("Compliance Automation (SOC 2, ISO)", "Identity & Access Management (IAM)", "Vulnerability Scanning"),
    ),
    Category(
        "it_management_itsm", "IT Management & IT Service Management",
        ("ITSM / IT Service Desk", "IT Asset Management (ITAM)", "Mobile Device Management (MDM)", "Network Monitoring",
         "SaaS Management Platform (SMP)"),
        ("it management", "itsm", "it service desk", "itam", "mdm", "device management", "sysadmin", "infrastructure monitoring", "servicenow"),
        ("it management", "itsm", "it service management", "it management & it service management", "it asset management", "mdm"),
        "VP of IT", ("IT Asset Management", "Mobile Device Management (MDM)", "IT Service Desk"),
    ),
    Category(
        "collaboration_communication", "Collaboration & Communication",
        ("Team Messaging", "Video Conferencing", "Team Workspace & Wiki", "Virtual Whiteboarding", "Asynchronous Collaboration"),
        ("collaboration", "communication", "messaging", "chat", "video conferencing", "wiki", "intranet", "whiteboard", "team workspace"),
        ("collaboration", "communication", "collaboration & communication", "team messaging", "video conferencing"),
        "Chief Information Officer (CIO)", ("Team Messaging", "Video Meetings", "Internal Knowledge Sharing"),
    ),
    Category(
        "legal_compliance", "Legal & Compliance",
        ("Contract Lifecycle Management (CLM)", "e-Signature & Document Verification", "Legal Practice Management", "Privacy & Regulatory SaaS",
         "IP Management"),
        ("legal", "compliance", "contract", "contracts", "clm", "e-signature", "gdpr", "law firm", "general counsel", "regulatory compliance"),
        ("legal", "compliance", "legal & compliance", "contract management", "clm"),
        "General Counsel", ("Contract Lifecycle Management (CLM)", "e-Signature & Approval", "Legal Matter Management"),
    ),
    Category(
        "data_analytics_bi", "Data & Analytics / Business Intelligence",
        ("Business Intelligence & Dashboards", "Data Pipelines / ETL SaaS", "Product Analytics", "Customer Data Platform (CDP)", "AI Analytics"),
        ("data", "analytics", "bi", "business intelligence", "dashboard", "reporting", "etl", "cdp", "data warehouse", "visualization", "metrics"),
        ("data & analytics", "analytics", "bi", "business intelligence", "data & analytics / business intelligence", "data pipeline"),
        "Head of Data", ("Executive Dashboards", "Data Pipeline / ETL", "Customer Data Platform (CDP)"),
    ),
    Category(
        "developer_tools", "Developer Tools",
        ("CI/CD & DevOps SaaS", "API Development & Testing", "Observability & Error Tracking", "Cloud Hosting & Deployment", "Code Review & Quality"),
        ("developer tools", "devtools", "devops", "ci/cd", "api", "git", "github", "testing", "monitoring", "logging", "observability", "engineering"),
        ("developer tools", "devtools", "devops", "software engineering tools", "ci/cd"),
        "Chief Technology Officer (CTO)",
        ("Code Repository & Version Control", "Continuous Integration / CD", "Error Monitoring & Logging"),
    ),
    Category(
        "productivity_workflow_automation", "Productivity & Workflow Automation",
        ("iPaaS / Workflow Automation", "AI Productivity Tools", "Appointment Scheduling", "No-Code Database SaaS", "Document Automation"),
        ("automation", "productivity", "workflow", "zapier", "scheduling", "no-code", "low-code", "rpa", "document processing"),
        ("productivity", "workflow automation", "productivity & workflow automation", "no-code automation"),
        "Head of Operations", ("No-Code Workflow Automation", "AI Document Summarization", "Calendar Scheduling"),
    ),
    Category(
        "ecommerce_retail_operations", "E-commerce & Retail Operations",
        ("Multichannel Inventory SaaS", "Shipping & Fulfillment SaaS", "Retail POS SaaS", "E-commerce Operations", "Returns & Logistics SaaS"),
        ("ecommerce", "e-commerce", "retail", "pos", "point of sale", "order fulfillment", "inventory sync", "shipping automation", "shopify", "store"),
        ("e-commerce", "ecommerce", "retail operations", "e-commerce & retail operations", "pos", "inventory management"),
        "Head of E-commerce", ("Multichannel Inventory Sync", "Order Fulfillment", "Shipping Label Automation"),
    ),
    Category(
        "education_learning_management", "Education & Learning Management",
        ("Corporate LMS", "Higher Ed LMS", "K-12 School Management", "Course Authoring & Training", "Skills Assessment SaaS",
         "Student Information System (SIS)"),
        ("education", "learning management", "lms", "corporate training", "e-learning", "skills development", "training", "school management",
         "school administration", "student management", "student", "school", "college", "edtech", "course"),
        ("education", "lms", "learning management", "education & learning management", "corporate training"),
        "Head of L&D (Learning & Development)",
        ("Corporate Training & LMS", "Employee Compliance Certification", "School Management System"),
    ),
    Category(
        "healthcare_business_software", "Healthcare Business Software",
        ("Practice Management SaaS", "Dental Practice Management SaaS", "Clinic Management SaaS", "Hospital Management (HIMS)", "EHR / EMR SaaS",
         "Medical Billing & RCM", "Telemedicine SaaS", "Diagnostic Lab Management", "Patient Management SaaS"),
        ("healthcare", "clinic", "hospital", "emr", "ehr", "hims", "telehealth", "telemedicine", "medical billing", "practice management", "dental",
         "dental practice", "diagnostic lab", "doctor", "physician", "patient", "patient management", "appointment", "clinic appointment"),
        ("healthcare", "healthcare saas", "healthcare business software", "clinic management", "clinic management saas", "hospital management",
         "hospital management saas", "ehr/emr", "ehr/emr saas", "telemedicine saas", "practice management", "dental practice management saas"),
        "Clinic Owner / Doctor", ("Clinic / Practice Management", "Hospital Information Systems (HIMS)", "EMR / EHR Charting"),
    ),
    Category(
        "real_estate_property_management", "Real Estate & Property Management",
        ("Residential Property Management", "Commercial Real Estate SaaS", "Tenant Portal & Lease SaaS", "Real Estate CRM"),
        ("real estate", "property management", "tenant", "landlord", "leasing", "rent collection", "facility maintenance", "commercial real estate"),
        ("real estate", "property management", "real estate & property management"),
        "Property Manager", ("Tenant Lease Management", "Rent Collection & Invoicing", "Maintenance Work Orders"),
    ),
    Category(
        "construction_field_service", "Construction & Field Service Management",
        ("Construction Management SaaS", "Field Service Management (FSM)", "Dispatch & Work Order SaaS", "Safety Inspection SaaS"),
        ("construction", "field service", "contractor", "subcontractor", "dispatch", "work order", "hvac", "plumbing", "jobsite", "technician"),
        ("construction", "field service", "construction & field service management", "field service management"),
        "General Contractor", ("Jobsite Scheduling", "Subcontractor Coordination", "Field Technician Dispatch"),
    ),
    Category(
        "logistics_transportation", "Logistics & Transportation Management",
        ("Transportation Management System (TMS)", "Fleet Management & Telematics", "Route Optimization SaaS", "3PL Logistics Platform"),
        ("logistics", "transportation", "tms", "fleet", "freight", "trucking", "route optimization", "carrier", "3pl", "dispatch"),
        ("logistics", "transportation", "logistics & transportation management", "fleet management", "tms"),
        "Fleet Manager", ("Fleet Route Optimization", "Transportation Management (TMS)", "Freight Brokerage & Dispatch"),
    ),
    Category(
        "fintech_saas", "FinTech & Payment SaaS",
        ("B2B Payment SaaS", "Subscription Billing SaaS", "Invoice Financing SaaS", "Corporate Treasury SaaS", "Embedded Banking SaaS"),
        ("fintech", "payment", "payments", "invoice financing", "receivables", "treasury", "gateway", "subscription billing", "billing automation",
         "banking api"),
        ("fintech", "fintech saas", "fintech & payment saas", "payment gateway", "invoice financing", "treasury management", "subscription billing"),
        "Chief Financial Officer (CFO)", ("B2B Payment Gateway", "Invoice Factoring / Financing", "Subscription Billing Automation"),
    ),
    Category(
        "manufacturing_operations", "Manufacturing & Industrial Operations",
        ("MES SaaS", "CMMS / Maintenance SaaS", "Plant Floor Management", "Quality Assurance SaaS", "Industrial IoT SaaS"),
        ("manufacturing", "plant floor", "mes", "cmms", "industrial", "factory", "machinery maintenance", "quality control", "oee", "shop floor"),
        ("manufacturing", "manufacturing saas", "manufacturing & industrial operations", "mes", "cmms", "plant operations", "factory management"),
        "VP of Manufacturing",
        ("Manufacturing Execution (MES)", "Computerized Maintenance Management (CMMS)", "Quality Control & Assurance"),
    ),
    Category(
        "hospitality_restaurant", "Hospitality & Restaurant Management",
        ("Restaurant Management SaaS", "Hotel PMS SaaS", "Table Booking SaaS", "Kitchen Display SaaS", "Bar & Food POS"),
        ("hospitality", "restaurant", "hotel", "pms", "table booking", "kitchen display", "food and beverage", "bar pos", "resort management",
         "guest management"),
        ("hospitality", "restaurant", "hospitality saas", "restaurant saas", "restaurant management", "hotel pms",
         "hospitality & restaurant management"),
        "Restaurant Owner", ("Restaurant POS & Ordering", "Hotel Property Management (PMS)", "Table Reservation Management"),
    ),
    Category(
        "vertical_saas", "Industry-Specific Vertical SaaS",
        ("Restaurant SaaS", "Salon & Spa Management", "Agriculture / AgriTech SaaS", "Hospitality Management"),
        ("vertical saas", "salon", "fitness studio", "agritech", "agriculture", "specialized saas"),
        ("vertical saas", "industry-specific vertical saas"),
        "Industry Business Owner", ("Industry-Specific Workflow", "Specialized Billing & Booking", "Vertical Regulatory Compliance"),
    ),
    Category(
        "other_b2b_saas", "Other B2B SaaS",
        ("General B2B SaaS", "Custom Enterprise SaaS"),
        ("b2b saas", "software as a service", "enterprise software", "b2b software"),
        (),
        "Business Executive", ("B2B Workflow Automation", "Specialized Business Solutions"),
    ),
)
